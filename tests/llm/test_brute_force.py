"""Operators that SQL can't express, against plain re-implementations, and secrets that the forest wasn't trained for."""

import hashlib
import math
import random
import uuid
from base64 import b64encode
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from rankloom.llm import langid, minhash, mixing, quality, secret_scan, spotsigs, substring, suffix
from rankloom.llm.common import table
from rankloom.llm.rolling import Text

SF = "/root/testdata/sf0.01"
TEXTS = ["The cat sat on the mat, and the dog didn't.", "Der Hund läuft über die Straße", "漢字 かな 123", "x", "  \t ", "", None, "a b a b a b the the of", "Ünïcode wörds; l'été est là", "no anchors here whatsoever friend " * 3]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# ---- language ----


def plain_counts(text):
    letters = [ch if ch.isalpha() else " " for ch in (text or "").lower()]
    if not any(x != " " for x in letters):
        return None
    s = " " + "".join(ch for i, ch in enumerate(letters) if ch != " " or i and letters[i - 1] != " ") + " "
    out = Counter()
    for n in langid.LENGTHS:
        for i in range(len(s) - n + 1):
            h = 0
            for ch in s[i : i + n]:
                h = (h + ord(ch)) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            out[(h * 0x85EBCA6B & 0xFFFFFFFF) >> 18] += 1
    return out


def test_language(spark):
    for t in TEXTS:
        got, want = langid.counts(t), plain_counts(t)
        assert (got is None) == (want is None) and (got is None or dict(zip(*(x.tolist() for x in got))) == want)
    learn = table(spark, SF, "documents").limit(300)
    model = langid.train(learn, 50)
    rows = [r for r in learn.collect() if r["lang"] and r["text"]]
    df, n = Counter(), 0
    for r in rows:
        if c := plain_counts(r["text"]):
            df.update(c.keys())
            n += 1
    for b in range(0, langid.BUCKETS, 97):
        assert model.idf[b] == pytest.approx(math.log((1 + n) / (1 + df[b])) + 1)
    for r in langid.predict(rows_of(spark, TEXTS), model).collect():
        c = plain_counts(TEXTS[r["doc_id"]])
        if c is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        x = {b: k * model.idf[b] for b, k in c.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        logits = [sum(v / length * float(model.weights[b][k]) for b, v in x.items()) / model.heat for k in range(len(model.languages))]
        p = [math.exp(z - max(logits)) for z in logits]
        best = max(range(len(p)), key=p.__getitem__)
        assert r["lang_pred"] == model.languages[best] and r["score"] == pytest.approx(p[best] / sum(p), abs=1e-6)


# ---- quality ----


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def plain_features(text):
    raw = (text or "").encode().split()
    hashes = [int(Text([w.decode()]).words().hashes()[0]) for w in raw]
    out = hashes + [mixed(a * 3 + b & (1 << 64) - 1) for a, b in zip(hashes, hashes[1:])]
    for n in quality.LENGTHS:
        for w in (f" {x.decode()} " for x in raw):
            for i in range(len(w) - n + 1):
                g = n
                for ch in w[i : i + n]:
                    g = mixed(g * 0x100000001B3 + ord(ch) & (1 << 64) - 1)
                out.append(g)
    return Counter([(g >> 7) & (quality.BUCKETS - 1) for g in out] + [quality.BUCKETS])


def test_quality(spark):
    for t, (at, n) in zip(TEXTS, quality.features(TEXTS)):
        assert dict(zip(at.tolist(), n.tolist())) == plain_features(t)
    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels"))
    for r in quality.score(rows_of(spark, TEXTS), model).collect():
        c = plain_features(TEXTS[r["doc_id"]])
        z = sum(model[b] * k for b, k in c.items()) / sum(c.values())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)


# ---- fingerprints ----


def plain_spots(text):
    """The word triples whose hashes make the fingerprint."""
    content, marks, pending = [], [], False
    for w in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()):
        if w in spotsigs.ANCHORS:
            pending = True
        else:
            content.append(w)
            marks.append(pending)
            pending = False
    padded = content + ["", ""]
    return {tuple(padded[i : i + 3]) for i in range(len(content)) if marks[i] or not any(marks[max(i - 2, 0) : i])} or {(text or "",)}


def test_fingerprints(spark):
    r = random.Random(4)
    some = ["the", "of", "und", "la", *(f"w{i}" for i in range(12))]
    texts = TEXTS + [" ".join(r.choice(some) for _ in range(r.randint(1, 60))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null the id one"), (None, "null the id two"), (5, "the same id"), (5, "the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tie = {x["text"]: x["h"] for x in df.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]), reverse=True)
    following = {i: order[(i + 1) % len(order)][1] for i in range(len(order))}
    edited = [t[: len(t) - len(t) // 3] + following[i][: len(t) // 3] for i, (_, t) in enumerate(order)]
    triples = sorted({x for t in [*edited, *(t for _, t in order)] for x in plain_spots(t)})
    hashed = spark.createDataFrame([(i, list(x)) for i, x in enumerate(triples)], "i int, x array<string>")
    three = F.hash(*(F.coalesce(F.get("x", F.lit(k)), F.lit("")) for k in range(3)))
    code = {triples[x["i"]]: x["h"] for x in hashed.select("i", F.when(F.size("x") == 1, F.hash(F.get("x", F.lit(0)))).otherwise(three).alias("h")).collect()}
    spots = lambda t: frozenset(code[x] for x in plain_spots(t))
    show = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x in sorted(s))
    like = lambda a, b: len(a & b) / len(a | b)
    want = Counter()
    for i, (d, t) in enumerate(order):
        own, new, other = spots(t), spots(edited[i]), spots(following[i])
        want[d, len(t), hashlib.sha256(edited[i].encode()).hexdigest(), show(own), show(new), round(like(own, new), 9), round(like(own, other), 9)] += 1
    got = Counter((x["doc_id"], x["n_chars"], x["edited_sha256"], x["fingerprint"], x["edited_fingerprint"], round(x["near_edited"], 9), round(x["near_next"], 9)) for x in spotsigs.fingerprints(df).collect())
    assert got == want


@pytest.mark.parametrize("per_range,quantiles", [(4096, 4096), (3, 4), (2, 1000)])
def test_next_rows(spark, per_range, quantiles):
    r = random.Random(per_range)
    rows = [(r.choice([None, r.randint(0, 40), r.randint(0, 10**12)]), f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tie = {x["text"]: x["h"] for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]), reverse=True)
    want = {t: order[(i + 1) % len(order)][1] for i, (_, t) in enumerate(order)}
    got = spotsigs.with_next(df, ["text"], quantiles=quantiles, per_range=per_range).collect()
    assert {x["text"]: x["next_text"] for x in got} == want and len(got) == 200


def test_mark_is_white_space(spark):
    a, b = "one two\u0001three four five", "one two three four five"
    got = spark.createDataFrame([(a,), (b,)], "t string").select(spotsigs.spots(F.col("t")).alias("s")).collect()
    assert got[0]["s"] == got[1]["s"]


# ---- secrets ----


def planted(seed=77):
    """Secrets and harmless tokens of forms that labelled_findings doesn't make, each in a sentence: text, value, secret."""
    r = random.Random(seed)
    raw = lambda n: bytes(r.randrange(256) for _ in range(n))
    b64 = lambda n: b64encode(raw(n)).decode()
    url = lambda n: b64(n).replace("+", "-").replace("/", "_").rstrip("=")
    secrets = [
        lambda: ("export DB_PASSWORD={}", r.choice(["Winter", "Sommer", "tiger", "Orchid"]) + str(r.randint(10, 9999)) + r.choice("!?#$")),
        lambda: ("headers: Authorization: Bearer {} end", ".".join((b64(27).rstrip("="), url(60), url(32)))),
        lambda: ("aws_access_key_id = {} in the profile", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
        lambda: ("aws_secret_access_key = {} there", b64(30)),
        lambda: ("connect to postgresql://admin:{}@db.internal:5432/prod now", url(9)),
        lambda: ('"client_secret": "{}", and so on', url(24)),
        lambda: ("stripe.api_key = '{}' was committed", "sk_live_" + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(24))),
        lambda: ("the token: {} leaked", raw(20).hex()),
        lambda: ("push with {} as user", "ghp_" + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))),
    ]
    harmless = [
        lambda: ("the request id {} was logged", str(uuid.UUID(bytes=raw(16), version=4))),
        lambda: ("fixed in commit {} last week", raw(20).hex()),
        lambda: ("see docs/{} for more", r.choice(["getting-started", "release-notes", "user-manual"]) + f"-{r.randint(2000, 2030)}.html"),
        lambda: ("call +{} today", r.randint(10**11, 10**12)),
        lambda: ("the isbn {} is out", f"978{r.randint(10**9, 10**10 - 1)}"),
        lambda: ("sha256 checksum {} matches", raw(32).hex()),
        lambda: ("at https://example.org/articles/{} we read", f"{r.randint(2000, 2030)}/05/the-long-way-home-{r.randint(1, 99)}"),
        lambda: ("in version {} it works", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}-beta{r.randint(1, 9)}"),
        lambda: ("the password: {} was asked for", r.choice(["required", "nothing", "never"])),
        lambda: ("set password={} in the template", r.choice(["changeme", "<password>", "${DB_PASSWORD}", "********"])),
    ]
    return [(t.format(v), str(v), kind is secrets) for kind in (secrets, harmless) for make in kind for _ in range(20) for t, v in [make()]]


def test_planted_secrets(spark):
    """Recall and precision over documents into which both kinds are planted."""
    cases = planted()
    docs = [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").limit(len(cases)).collect()]
    rows = []
    for i, ((sentence, _, _), t) in enumerate(zip(cases, docs)):
        words = t.split(" ")
        at = len(words) // 2
        rows.append((i, " ".join([*words[:at], sentence, *words[at:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = secret_scan.dictionary(table(spark, SF, "documents"))
    trees = secret_scan.train(spark, words=known)
    got = {r["doc_id"]: r["_redacted"] for r in secret_scan.scan(df, trees, words=known).collect()}
    gone = [v not in got[i] for i, (_, v, _) in enumerate(cases)]
    hit = sum(g and s for g, (_, _, s) in zip(gone, cases))
    recall, precision = hit / sum(s for _, _, s in cases), hit / max(sum(gone), 1)
    print(f"recall {recall:.3f}, precision {precision:.3f}", [(s, v) for g, (s, v, y) in zip(gone, cases) if g != y][:12])
    assert recall >= 0.9 and precision >= 0.9


def test_dictionary(spark):
    df = spark.createDataFrame([("alpha beta alpha", ), ("Alpha, gamma",), (None,), ("abc " * 50,)], "text string")
    assert secret_scan.dictionary(df, 2) == ("alpha", "beta") and secret_scan.dictionary(df.limit(0)) == ()


def test_callers_columns_stay(spark):
    odd = spark.createDataFrame([(1, "the password = hunter2secret99", "s", 1.5, 2, "x")], "doc_id long, text string, source string, _found double, _bin int, row string")
    got = secret_scan.scan(odd, secret_scan.train(spark)).first()
    assert (got["_found"], got["_bin"], got["row"]) == (1.5, 2, "x") and "[SECRET]" in got["_redacted"]
    d = mixing.with_quality(odd.withColumn("id", F.lit(9)).withColumn("q", F.lit("q")).withColumn("_weight", F.lit(3)), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    got = mixing.mix(d, F.col("_quality"), F.lit(4), F.col("doc_id").cast("string")).first()
    assert (got["_found"], got["_bin"], got["row"], got["id"], got["q"], got["_weight"], got["size"]) == (1.5, 2, "x", 9, "q", 3, 4)


# ---- near copies ----


def exact_components(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    likeness = {}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if both:
                likeness[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))], likeness


@pytest.mark.parametrize("few,block", [(4, 256), (1, 8)])
def test_recall_near_the_threshold(spark, monkeypatch, few, block):
    """Pairs at 0.75 to 0.85 alone, and among many documents that share a long passage and are otherwise unlike."""
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(few)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(150)]
    texts = []
    for i in range(160):
        own = [word() for _ in range(150)] if i % 2 else [*shared[: r.randint(120, 150)], *(word() for _ in range(90))]
        copy = list(own)
        for at in r.sample(range(len(copy)), r.randint(3, 5)):
            copy[at] = word()
        texts += [" ".join(own), " ".join(copy)]
    r.shuffle(texts)
    want, likeness = exact_components(texts)
    assert sum(0.75 <= x <= 0.85 for x in likeness.values()) > 60 and sum(0.3 < x < 0.75 for x in likeness.values()) > 1000
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(rows_of(spark, texts)).collect()}
    linked = [(a, b) for (a, b), x in likeness.items() if x >= 0.75]
    assert sum(got[a] == got[b] for a, b in linked) >= 0.99 * len(linked)
    assert all(want[a] == want[b] for a in range(len(texts)) for b in (got[a],))


# ---- mixing ----


def test_mixing_ties(spark):
    rows = [(None, "s", i, f"t{i}") for i in (1, 2, 3, 50, 7)] + [(4, "s", i, f"u{i}") for i in (5, 5, 90)]
    taken = []
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, source string, n int, t string").repartition(3)
        got = mixing.mix(d, F.lit(1.0), F.col("n"), [F.col("doc_id").cast("string"), F.col("t")], share=0.4).collect()
        taken.append(sorted((str(r["doc_id"]), r["t"], r["taken"]) for r in got))
    assert taken[0] == taken[1]


def test_mixing_fills_what_long_documents_leave(spark):
    for seed in range(6):
        d = spark.createDataFrame([(0, "s", 3000), *((i, "s", 10) for i in range(1, 701))], "doc_id long, source string, n int")
        got = mixing.mix(d, F.lit(1.0), F.col("n"), F.col("doc_id").cast("string"), share=0.14, seed=seed, ranges=9).collect()
        assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 10


# ---- long texts ----


def test_long_texts(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    long = [word() for _ in range(180_000)]
    other = [word() for _ in range(300)] + long[90_000:90_400] + [word() for _ in range(200)]
    texts = [" ".join(other), " ".join(long), " ".join(long[170_000:]), " ".join(long[:100])]
    assert len(texts[1]) > 1 << 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first: dict[int, int] = {}
    lists = [t.encode().split() for t in texts]
    keys = [[hash(tuple(w[s : s + 50])) for s in range(len(w) - 49)] for w in lists]
    for d, k in enumerate(keys):
        for h in k:
            first.setdefault(h, d)
    for x in substring.dedup(df).collect():
        w, lost = lists[x["doc_id"]], np.zeros(len(lists[x["doc_id"]]), bool)
        for s, h in enumerate(keys[x["doc_id"]]):
            if first[h] < x["doc_id"]:
                lost[s : s + 50] = True
        kept = b" ".join(a for a, gone in zip(w, lost.tolist()) if not gone)
        assert (x["n_removed"], x["kept_sha256"]) == (int(lost.sum()), hashlib.sha256(kept).hexdigest())
    raw = [t.encode() for t in texts]
    seen = Counter(hash(b[s : s + 200]) for b in raw for s in range(len(b) - 199))
    for x in suffix.dedup(df).collect():
        b, mark = raw[x["doc_id"]], np.zeros(len(raw[x["doc_id"]]) + 1, np.int64)
        for s in range(len(b) - 199):
            if seen[hash(b[s : s + 200])] > 1:
                mark[s] += 1
                mark[s + 200] -= 1
        lost = np.cumsum(mark)[:-1] > 0
        assert (x["n_removed"], x["kept_sha256"]) == (int(lost.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~lost].tobytes()).hexdigest())


def test_levels():
    assert substring.levels(50, 13) == [13, 25, 50] and substring.levels(50, 7) == [7, 13, 25, 50] and substring.levels(50, 40) == [50]


@pytest.mark.parametrize("shortest", [7, 13, 30])
def test_levels_agree(spark, shortest):
    r = random.Random(2)
    parts = [[r.choice("ab cd efg hij klmno".split()) for _ in range(80)] for _ in range(6)]
    texts = [" ".join(w for k in range(3) for w in r.choice(parts)[: r.randint(40, 80)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(substring.dedup(df, shortest=shortest)) == rows(substring.dedup(df, shortest=20))
