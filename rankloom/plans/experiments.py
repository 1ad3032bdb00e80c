"""Experiment grids and the search plan that a configuration names."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from itertools import product
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, lexical, tuning
from ..operators.ranking import normalized
from ..sources.storage import kept

__all__ = ["PRESETS", "Config", "by_name", "combinations", "flags", "fuse", "load_config", "replace", "retrieve", "run_all", "search"]


def load_config(path: str) -> dict:
    """JSON, or YAML where a reader for it is installed; by file name."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    raise ValueError(f"{path}: neither json nor yaml")


def combinations(config: dict) -> list[dict]:
    """Every combination of `iterate` values, over what `param_mapping` sets for a value, over `fixed`."""
    iterate, mapping = config.get("iterate", {}), config.get("param_mapping", {})
    out = []
    for values in product(*iterate.values()):
        chosen = dict(zip(iterate, values))
        extra: dict = {}
        for name, value in chosen.items():
            extra |= mapping.get(name, {}).get(value, {})
        out.append({**config.get("fixed", {}), **extra, **chosen})
    return out


def flags(config: dict) -> list[str]:
    """A configuration as command-line words: a list follows its flag joined by spaces, True is a flag alone, False nothing.
    Each call starts from nothing, so that no combination's flags reach the next."""
    out: list[str] = []
    for key, value in config.items():
        if value is True:
            out.append(f"--{key}")
        elif value is not False:
            out += [f"--{key}", " ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)]
    return out


def run_all(config: dict, run: Callable[[dict], object]) -> list[tuple[dict, object]]:
    """run(combination) for every combination, one after the other, with what each gave; the first that raises ends it."""
    return [(c, run(c)) for c in combinations(config)]


@dataclass
class Config:
    """What a search does: lists to fuse and how, depths, and parameters of the models.

    lists: list_ids of the runs to fuse; queries: kinds of query texts, one a list (see search.query_list). model: BM25,
    dense, sparse; reranker: none, pointwise, listwise.
    """

    lists: list[int] = field(default_factory=lambda: [0])
    fusion: str = "none"
    normalization: str = "min-max"
    weights: list[float] = field(default_factory=list)
    tuning: str = "none"
    k: int = 1000
    k1: float = 0.9
    b: float = 0.4
    steps: int = 10
    feedback: bool = False
    seed: int = 42
    queries: tuple[str, ...] = ()
    retrieval_query: str = "raw"
    reranking_query: str = "raw"
    generation_query: str = "none"
    level_type: str = "gpt-4o_judge_and_rewrite"
    group: str = "all"
    model: str = "BM25"
    reranker: str = "none"
    rerank_k: int = 50
    window: int = 20
    step: int = 10
    fb_docs: int = 10
    fb_terms: int = 10
    original_weight: float = 0.5
    query_weight: float = 0.0

    @classmethod
    def of(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


def three(model: str = "gpt-4o", last: str = "judge_and_rewrite_rw") -> dict:
    """The three texts of the main method by a model: a rewrite, the rewrite with its response, and a judged rewrite."""
    return {"lists": [0, 1, 2], "queries": (f"{model}_rar_rw", f"{model}_rar_rwrs", f"{model}_{last}"), "reranking_query": f"{model}_{last}"}


def tuned(tuning: str = "group", level: str = "gpt-4o_judge_and_rewrite", **more) -> dict:
    return {"fusion": "per_query", "tuning": tuning, "level_type": level, **more}


def generated(model: str, n: int) -> dict:
    """n queries that a model generated at once."""
    kinds = tuple(f"{model}_mq_{n}_{i + 1}" for i in range(n)) if n > 2 else tuple(f"{model}_mq_{i + 1}" for i in range(n))
    return {"lists": list(range(n)), "queries": kinds, "reranking_query": f"{model.replace('_GtR', '_MQ4CS')}_persq_rw", "normalization": "none"}


TWO = {"lists": [0, 1], "queries": ("gpt-4o_rar_rw", "gpt-4o_judge_and_rewrite_rw"), "reranking_query": "gpt-4o_judge_and_rewrite_rw"}
#: Families of settings by name. two_lists_late is that of two_lists over runs that hold three.
PRESETS = {
    "by_level": Config(**three(), **tuned()),
    "by_level_unnormalized": Config(**three(), **tuned(normalization="none")),
    "rerank_stored": Config(**three(), level_type="gpt-4o_judge_and_rewrite"),
    "two_lists": Config(**TWO, **tuned(), rerank_k=50),
    **{f"two_lists_{k}": Config(**TWO, **tuned(), k=max(k, 1000), rerank_k=k) for k in (100, 1000, 2000)},
    "two_lists_late": Config(**{**TWO, "lists": [0, 2]}, **tuned()),
    "depersonalized": Config(**three(last="judge_and_rewrite_depers_rw"), **tuned()),
    "depersonalized_by_hand": Config(**three(last="rar_manual_depersonalized_cot1_rw"), **tuned()),
    "depersonalized_fold": Config(**three(last="rar_manual_depersonalized_cot1_rw"), fusion="linear_weighted_score", weights=[0.1, 0.4]),
    "without_reasons": Config(**three(last="jtr_wo_cot_rw"), **tuned(level="gpt-4o_jtr_wo_cot")),
    "without_examples": Config(**three(last="jtr_wo_in_context_rw"), **tuned(level="gpt-4o_jtr_wo_in_context")),
    "mistral": Config(**three("mistral"), **tuned(level="mistral_judge_and_rewrite")),
    "llama3.1": Config(**three("llama3.1"), **tuned(level="llama3.1_judge_and_rewrite")),
    "unsupervised": Config(**three(), **tuned("retrieval_score")),
    "one_weight": Config(**three(), **tuned("no_level")),
    "two_plus_one": Config(**three(), **tuned("2+1")),
    "level_weights": Config(**three(), fusion="per_query"),
    "equal": Config(**three(), fusion="linear_combination", weights=[1.0, 1.0, 1.0]),
    "reciprocal_rank": Config(**three(), fusion="RRF", normalization="none"),
    "round_robin": Config(**three(), fusion="round_robin", normalization="none"),
    "concat": Config(**three(), fusion="concat", normalization="none"),
    "fold": Config(**three(), fusion="linear_weighted_score", weights=[0.1, 0.4]),
    "submission": Config(**three(last="rar_personalized_cot1_rw"), fusion="linear_weighted_score", weights=[0.1, 0.4]),
    "generated_2": Config(**generated("gpt-4o_MQ4CS", 2), fusion="concat", k=2000, rerank_k=2000, reranker="pointwise"),
    **{f"{m}_3_{f}": Config(**generated(f"gpt-4o_{m}", 3), fusion=f) for m in ("GtR", "MQ4CS") for f in ("round_robin", "RRF")},
    **{f"{m}_3_grid": Config(**{**generated(f"gpt-4o_{m}", 3), "normalization": "min-max"}, **tuned("no_level")) for m in ("GtR", "MQ4CS")},
    **{f"{m}_3": Config(**generated(f"gpt-4o_{m}", 3), fusion="concat", k=3000, rerank_k=3000, reranker="pointwise") for m in ("GtR", "MQ4CS")},
}


def by_name(lists: list[str], weights: list[float]) -> Config:
    """Texts and their weights, for a weighted sum of two or three lists."""
    return Config(lists=list(range(len(lists))), queries=tuple(lists), fusion="linear_combination", weights=weights)


def retrieve(queries: DataFrame, lists: DataFrame, config: Config) -> DataFrame:
    """Runs of all lists at once: queries (list_id, qid, words)."""
    keys = ["list_id", "qid"]
    weights = lexical.query_terms(queries.filter(queries["list_id"].isin(config.lists)), keys)
    run = lexical.bm25(weights, lists, keys, config.k, config.k1, config.b)
    if config.feedback:
        more = kept(lexical.feedback_terms(weights, run, lists, keys, config.fb_docs, config.fb_terms, config.original_weight))
        run = lexical.bm25(more, lists, keys, config.k, config.k1, config.b)
    return run


def fuse(runs: DataFrame, config: Config, levels: DataFrame | None = None, qrels: DataFrame | None = None) -> DataFrame:
    """The fused run that config names. levels: (qid, level); qrels where weights are tuned by judgements."""
    n = len(config.lists)
    if config.fusion == "none":
        return runs.filter(runs["list_id"] == config.lists[0]).select("qid", "docid", "score", "rank")
    # from here on a list goes by its place among config's lists
    place = F.array_position(F.array(*map(F.lit, config.lists)), F.col("list_id")) - 1
    runs = runs.filter(F.col("list_id").isin(config.lists)).withColumn("list_id", place.cast("int"))
    runs = normalized(runs, config.normalization, ["list_id", "qid"])
    if config.fusion == "RRF":
        return fusion.reciprocal_rank(runs, config.k)
    if config.fusion == "round_robin":
        return fusion.round_robin(runs, n, config.k, config.seed)
    if config.fusion == "concat":
        return fusion.concatenation(runs)
    if config.fusion == "linear_weighted_score":
        return fusion.fold([runs.filter(runs["list_id"] == i).drop("list_id") for i in range(n)], config.weights, config.k)
    if config.fusion == "linear_combination":
        return fusion.linear_combination(runs, fusion.same_weights(runs, config.weights), config.k)
    if config.fusion != "per_query":
        raise ValueError(f"unknown fusion {config.fusion!r}")
    groups = levels.withColumnRenamed("level", "grp")
    if config.tuning == "none":
        return fusion.linear_combination(runs, fusion.level_weights(levels), config.k)
    runs = kept(runs)  # tuned weights come back to the same lists
    if config.tuning == "2+1":
        return tuning.two_plus_one(runs, qrels, groups, config.steps, config.k)
    trials = tuning.grid(n, config.steps)
    if config.tuning == "retrieval_score":
        found = tuning.by_score(runs, groups, n, trials)
    else:
        groups = groups if config.tuning == "group" else groups.withColumn("grp", F.lit("all"))
        found = tuning.supervised(runs, qrels, groups, n, trials)
    return fusion.linear_combination(runs, tuning.weights_of(tuning.best(found, ["grp"]), groups), config.k)


def search(queries: DataFrame, lists: DataFrame, config: Config, levels: DataFrame | None = None, qrels: DataFrame | None = None) -> DataFrame:
    """Retrieve every list, normalise, fuse."""
    return fuse(retrieve(queries, lists, config), config, levels, qrels)
