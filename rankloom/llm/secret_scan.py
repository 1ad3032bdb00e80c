"""Secret scanning: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only."""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Telling names, by their ends: client_secret and aws_secret_access_key are among them.
NAMES = (
    r"(?i:pass|password|passwd|passphrase|passcode|pwd|secret|token|credentials?|auth|passwort|kennwort|contraseña|contrasena|mot de passe"
    r"|(?:api|access|private|secret|auth|account|encryption|signing|signature|shared|master)[_\-. ]?key)"
)
#: A telling name, quoted or not, and what assigns a value to it; white space is free.
ASSIGN = NAMES + r"""["']?\s{0,8}(?:=>|:=|[=:])\s{0,8}["']?"""
BEARER, URL = r"(?i:bearer|basic)\s{1,4}", r"://[^\s:/@]{0,64}:"
PREFIXES = "AKIA|ASIA|gh[opusr]_|glpat-|[srp]k_(?:live|test)|sk-|xox[abeprs]-|AIza|eyJ|-----BEGIN"
#: What may be a secret: a private key block, a password in a URL, a value assigned to a telling name or sent as a bearer,
#: a token of a known prefix, or a long token with a digit in it. The gate is loose; the forest rejects.
#: The long look-behinds are tried only after =, :, quotes and white space that follows one of the first three or a scheme's name.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
    rf"""|(?<=:)(?<={URL})[^\s/@"']{{1,200}}(?=@)"""
    rf"""|(?<=[=:>"'\s])(?<=[=:>]\s{{0,8}}["']?)(?<={ASSIGN})(?!{BEARER})[^\s"']{{4,}}"""
    rf"""|(?<=\s)(?<={BEARER})[A-Za-z0-9+/_\-.~]{{12,}}={{0,2}}"""
    rf"""|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{{12,}}|(?<![A-Za-z0-9])(?:gh[opusr]_|glpat-|[srp]k_(?:live|test)|sk-|xox[abeprs]-|AIza|eyJ)[A-Za-z0-9+/_\-.]{{12,}}={{0,2}}"""
    r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}={0,2}"
)
REPLACEMENT = "[SECRET]"
#: Words whose share of a candidate is its dictionary coverage, and words near a candidate that speak for or against it.
DICTIONARY = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who did its let put say she too use "
    "that with have this will your from they know want been good much some time very when come here just like long make many over such take than them well were "
    "version example sample test data file image video photo report page index main user name value config build release model number item order part "
    "janu febr march april june july august sept octo nove dece monday friday update final draft copy backup project service server client public static "
    "ation ing tion ment ness able ible heit keit ung lich sch ein ver cion mente ado eau eux oir"
).split()
CUES = "password passwd pwd secret token apikey api_key key auth credential credentials private bearer login access passphrase authorization passwort kennwort".split()
AGAINST = "example sample test dummy placeholder commit sha sha1 sha256 md5 checksum hash uuid guid version release build isbn order invoice phone card tracking image file path rev revision".split()
#: Words of the corpus that count as its dictionary: the most frequent ones by documents.
MOST_WORDS = 2000
TREES, DEPTH, FINDINGS = 25, 6, 150


def dictionary(docs: DataFrame, most: int = MOST_WORDS) -> tuple[str, ...]:
    """The `most` words of 4 to 16 letters that most documents of docs have, by all rows and whole texts; ties by the word.
    Null texts have none; the words are what comes to the driver, and their number is the bound."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w).between(4, 16)))
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").count()
    return tuple(r["w"] for r in counted.orderBy(F.col("count").desc(), "w").limit(most).collect())


def features(c: str, words: tuple[str, ...] = ()) -> str:
    """SQL for the numbers that describe candidate c, a struct of v (value), b (text before) and a (text after); words: the
    corpus's dictionary."""
    v, n = f"{c}.v", f"greatest(length({c}.v), 1)"
    count = lambda what, pattern: f"regexp_count({what}, '{pattern}')"
    near = f"lower(concat({c}.b, ' ', {c}.a))"
    word = lambda words: f"(?<![a-z0-9])({'|'.join(words)})(?![a-z])"
    quoted = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    known = "array(" + ", ".join(map(quoted, words or ("",))) + ")"
    turns = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"
    items = [
        f"least(length({v}), 200)",
        f"{count(v, '[0-9]')} / {n}",
        f"{count(v, '[A-Z]')} / {n}",
        f"{count(v, '[a-z]')} / {n}",
        f"{count(v, turns)} / {n}",
        f"aggregate(filter(regexp_extract_all({v}, '[A-Z]?[a-z]{{3,}}|[A-Z]{{4,}}', 0), p -> array_contains({known}, lower(p))), 0, (s, p) -> s + length(p)) / {n}",
        f"1 - length(regexp_replace(lower({v}), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', '')) / {n}",
        f"{count(f'lower({v})', '[aeiou]')} / {n}",
        f"{count(f'lower({v})', '[g-z]')} / {n}",
        f"size(array_distinct(split({v}, ''))) / least({n}, 40)",
        f"{count(v, '[/._-]')} + {count(f'right({c}.b, 1)', '[/.@]')} * 2 + {count(f'left({c}.a, 1)', '[/.@]')} * 2",
        f"{count(near, word(CUES))}",
        f"{count(near, word(AGAINST))} + {count(f'lower({v})', 'example|sample|your|dummy|placeholder|changeme')}",
        f"cast({c}.b rlike '[=:>]\\\\s{{0,8}}[\"\\']?$' as int)",
        f"cast({v} rlike '^(?:{PREFIXES})' as int) - {count(v, '(.)\\\\1{4,}')} - {count(v, '1234|abcd')}",
        f"cast({c}.b rlike {quoted(ASSIGN + '$')} as int) + 2 * cast({c}.b rlike {quoted(BEARER + '$')} or ({c}.b rlike {quoted(URL + '$')} and {c}.a like '@%') as int)",
    ]
    return "array(" + ", ".join(f"cast({x} as double)" for x in items) + ")"


def labelled_findings(each: int = FINDINGS, seed: int = 9, corpus: tuple[str, ...] = ()) -> list[dict]:
    """Findings with labels, made by rule: `each` of every kind of true and of false one, of words of the corpus's dictionary
    too. The documented bound on what trains the forest."""
    r = random.Random(seed)
    pools = [x for x in ([w for w in DICTIONARY if len(w) > 3], [w for w in corpus if w.isascii()]) if x]
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    fill = lambda n: " ".join(pick(low, r.randint(2, 8)) for _ in range(n))
    some = lambda *x: r.choice(x)
    words = lambda n, sep: sep.join(r.choice(r.choice(pools)) for _ in range(n))
    spell = lambda k: "".join(r.choice("bcdfghjklmnprstvw") + r.choice("aeiou") + some("", "n", "r", "s") for _ in range(k))
    telling = lambda: some("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "aws_secret_access_key", "client_secret", "passphrase", "Password", "auth_token")
    assigned = lambda: " " + some('{"%s": "', "%s=", "%s: ", "%s:  ", '%s = "', "%s => '", "'%s': '") % telling()
    password = lambda: some(str, str.capitalize)(spell(some(2, 3))) + some("", pick("!$%&*#?_-", 1)) + pick(dig, some(1, 2, 3, 4)) + some("", pick("!$%&*#?", 1))
    true = [
        lambda: (some("AKIA", "ASIA") + pick(up + "234567", 16), fill(5) + " ", " " + fill(2)),
        lambda: (some("ghp_", "gho_", "sk_live", "xoxb-", "AIza") + pick(low + up + dig, r.randint(24, 40)), fill(4) + " ", " " + fill(2)),
        lambda: (pick(hexa, some(16, 18, 20, 24, 32)), fill(3) + " " + some("password", "passwd", "secret", "pwd") + some("=", ": ", " = "), " " + fill(2)),
        lambda: (pick(hexa, some(32, 40, 64)), fill(3) + " " + some("token", "api_key", "secret", "apikey") + some(" = ", "=", ": ") + some('"', "'", ""), some('"', "'", "") + " " + fill(2)),
        lambda: (pick(low + up + dig + "+/", some(24, 32, 40)) + pick(dig, 1) + some("", "=", "=="), fill(3) + " " + some("key", "secret", "auth", "bearer", "access") + some(" ", "=", ": "), " " + fill(2)),
        lambda: (pick(low + up + dig, 6) + pick("!$%&*#?", 2) + pick(dig, 3), fill(3) + " " + some("password", "pwd") + some("=", ": "), " " + fill(2)),
        lambda: (pick(low + up + dig, r.randint(32, 48)), fill(4) + " ", " " + fill(2)),
        lambda: (some("ghp_", "gho_", "sk_live_", "xoxb-", "AIza", "glpat-") + pick(low + up, r.randint(16, 40)), fill(4) + " ", " " + fill(2)),
        lambda: (password(), fill(3) + assigned(), some('"', "'", "") + some(" ", "}", ", ") + fill(2)),
        lambda: (some(words(1, ""), pick(low, r.randint(4, 8)), spell(2)) + pick(dig, some(1, 1, 2, 3)), fill(some(0, 3)) + assigned(), some('"', "'", "") + some(" ", "}", ", ") + fill(2)),
        lambda: (pick(low + up, r.randint(12, 40)), fill(3) + assigned(), some('"', "'", "") + " " + fill(2)),
        lambda: (pick(low + up + some("", dig), r.randint(14, 40)), fill(3) + some(" ", " Authorization: ", ' "Authorization": "') + some("Bearer ", "bearer ", "Basic "), some('"', "") + " " + fill(2)),
        lambda: (some(password(), pick(low + dig, r.randint(6, 12)), pick(low + up + dig, 20)), fill(3) + " " + some("postgres", "mysql", "https", "redis", "amqp") + "://" + pick(low, some(0, 3, 6)) + ":", "@" + pick(low, 6) + some(".com/", ":5432/") + fill(1)),
    ]
    false = [
        lambda: (pick(dig, r.randint(12, 19)), fill(3) + " " + some("", "order ", "phone ", "card "), " " + fill(2)),
        lambda: (words(some(2, 3, 4), some("-", "_", "")) + pick(dig, some(1, 2, 4)), fill(4) + " ", some(" ", ".", ", ") + fill(2)),
        lambda: (words(some(2, 3, 4), "/") + "/" + words(1, "") + pick(dig, 2), fill(3) + some(" ", " /"), some(".html ", ".java ", " ", "/") + fill(1)),
        lambda: (pick(hexa, 40), fill(3) + " " + some("commit", "sha", "sha1", "rev", "checksum") + some(" ", ": ", "="), " " + fill(2)),
        lambda: (pick(hexa, 8) + "-" + pick(hexa, 4) + "-4" + pick(hexa, 3) + "-a" + pick(hexa, 3) + "-" + pick(hexa, 12), fill(3) + some(" ", " uuid ", " guid: "), " " + fill(2)),
        lambda: ("20" + pick("12", 1) + pick(dig, 1) + some("-", "") + "0" + pick("123456789", 1) + some("-", "") + "1" + pick(dig, 1) + "T" + pick("01", 2) + "5" + pick(dig, 1) + "00" + "00", fill(3) + " ", " " + fill(2)),
        lambda: (some("your_api_key_", "example_token_", "changeme_", "dummy-secret-") + pick(dig, 4), fill(3) + " " + some("api_key", "token", "password") + some("=", ": "), " " + fill(2)),
        lambda: (some("x", "0", "*", "a") * r.randint(10, 30) + "1234", fill(3) + " " + some("password", "token", "key") + some("=", " ", ": "), " " + fill(2)),
        lambda: (pick(low, r.randint(8, 14)) + pick(dig, some(1, 2)) + pick(low, some(0, 3)), fill(4) + " ", some(" ", ". ", "@") + fill(2)),
        lambda: (pick(up, r.randint(9, 14)) + pick(dig, some(1, 3)), fill(4) + " " + some("version ", "isbn ", "build ", ""), " " + fill(2)),
        lambda: (some(spell(some(2, 3, 4)), words(1, ""), pick(low, r.randint(4, 9))) + some("", "", ".", ",", ";"), fill(3) + assigned(), some('"', "'", "") + some(" ", ", ") + fill(2)),
        lambda: (some("None", "null", "true", "false", "undefined", "string", "required", "${PASSWORD}", "$TOKEN", "<password>", "********", "process.env.TOKEN", "os.environ[", "getPassword()", "config.secret", "{{token}}"), fill(3) + assigned(), some('"', "'", "") + some(" ", ", ") + fill(2)),
        lambda: (spell(r.randint(5, 7)), fill(3) + some(" bearer ", " basic ", " Basic "), some(" ", ". ") + fill(2)),
        lambda: (some("sk-", "eyJ", "sk-") + words(some(3, 4), "-") , fill(4) + " ", some(" ", ".", ", ") + fill(2)),
    ]
    out = []
    for y, kinds in ((1, true), (0, false)):
        for kind in kinds:
            for _ in range(each):
                v, b, a = kind()
                out.append({"v": v, "b": b[-48:], "a": a[:16], "y": y})
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree as (feature, cut, low side, high side), leaves the share of true findings; each split tries some features."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return float(y.mean())
    best = (1e9, None)
    for f in rng.choice(x.shape[1], 4, replace=False).tolist():
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(k):
            continue
        a, b, n = t[k - 1], t[-1] - t[k - 1], len(y)
        impurity = a * (k - a) / k + b * (n - k - b) / (n - k)
        i = int(impurity.argmin())
        if impurity[i] < best[0]:
            best = (impurity[i], (f, float((v[k[i] - 1] + v[k[i]]) / 2)))
    if best[1] is None:
        return float(y.mean())
    f, at = best[1]
    low = x[:, f] <= at
    return f, at, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def as_sql(tree, f: str) -> str:
    if isinstance(tree, float):
        return f"{tree:.4f}D"
    return f"if({f}[{tree[0]}] <= {tree[1]!r}D, {as_sql(tree[2], f)}, {as_sql(tree[3], f)})"


@lru_cache(maxsize=4)
def forest(rows: str, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> tuple:
    """Trees from a JSON list of [features, label], each on a bootstrap of the rows."""
    data = json.loads(rows)
    x, y = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    rng = np.random.default_rng(seed)
    return tuple(grow(x[i], y[i], rng, depth) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees)))


def train(spark: SparkSession, findings: list[dict] | None = None, words: tuple[str, ...] = ()) -> tuple:
    """The forest from labelled findings (v, b, a, y); their features come from the same SQL as those of candidates."""
    given = json.dumps(findings or labelled_findings(corpus=words))
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(given), "array<struct<v:string,b:string,a:string,y:int>>")).alias("c")).selectExpr(f"{features('c', words)} as f", "c.y").collect()
    return forest(json.dumps([[list(r["f"]), r["y"]] for r in rows]))


def scan(docs: DataFrame, trees: tuple, threshold: float = 0.5, words: tuple[str, ...] = ()) -> DataFrame:
    """Add _candidates (array of v, b, a), _scores (each candidate's share of trees that call it a secret), _redacted (the
    text with secrets replaced) to docs, which keeps all its other columns. words: the dictionary the trees were trained with.

    A null text has no candidates and stays null, an empty one stays empty; whole texts are read, however long; there is
    no shuffle, so a lost task runs again. A score of exactly the threshold counts as a secret. Equal rows get equal
    results; columns of docs called _candidates, _scores or _redacted are replaced; no rows give no rows.
    """
    names = [c for c in docs.columns if c not in ("_candidates", "_scores", "_redacted")]
    pattern = F.lit(CANDIDATE)
    d = docs.select(F.struct(*names).alias("row"), F.col("text"))
    d = d.withColumn("found", F.struct(F.regexp_extract_all("text", pattern, F.lit(0)).alias("c"), F.split("text", CANDIDATE, -1).alias("p")))
    d = d.withColumn("_candidates", F.expr("transform(array(found), x -> transform(x.c, (v, i) -> struct(v as v, right(x.p[i], 48) as b, left(x.p[i + 1], 16) as a)))[0]"))
    vote = " + ".join(as_sql(t, "f") for t in trees)
    d = d.withColumn("_scores", F.expr(f"transform(transform(_candidates, c -> {features('c', words)}), f -> ({vote}) / {len(trees)})"))
    redact = f"if(exists(_scores, s -> s >= {threshold}D), transform(array(struct(found, _scores)), x -> array_join(transform(x.found.p, (t, i) -> concat(t, if(i < size(x.found.c), if(x._scores[i] >= {threshold}D, '{REPLACEMENT}', x.found.c[i]), ''))), ''))[0], text)"
    return d.withColumn("_redacted", F.expr(redact)).select(*(F.col("row")[c].alias(c) for c in names), "_candidates", "_scores", "_redacted")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the number of candidates and of secrets, the highest score, and the SHA-256 of the redacted text.

    A null text counts as empty and has no candidates; equal rows get equal results; whole texts are read, however long; other
    columns are ignored; no rows give no rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = dictionary(docs)
    found = scan(docs, train(spark, words=words), words=words)
    return found.select("doc_id", F.size("_candidates").cast("long").alias("n_candidates"), F.expr("size(filter(_scores, s -> s >= 0.5D))").cast("long").alias("n_secrets"), F.coalesce(F.array_max("_scores"), F.lit(0.0)).alias("top_score"), F.sha2(F.encode("_redacted", "UTF-8"), 256).alias("redacted_sha256"))
