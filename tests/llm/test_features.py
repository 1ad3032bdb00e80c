"""The features of secret candidates against a plain version."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from rankloom.llm import secret_scan as s


def plain(v, b, a, words):
    n, count = max(len(v), 1), lambda p, t: len(regex.findall(p, t))
    near = f"{b} {a}".lower()
    word = lambda of: r"(?<![a-z0-9])(?:" + "|".join(of) + r")(?![a-z])"
    kind = lambda c: "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "d" if "0" <= c <= "9" else "o"
    turn = {("l", "u"), ("l", "d"), ("u", "l"), ("u", "d"), ("d", "l"), ("d", "u"), ("l", "o"), ("u", "o"), ("d", "o")}
    known = sum(len(p) for p in regex.findall("[A-Z]?[a-z]{3,}|[A-Z]{4,}", v) if p.lower() in words)
    left = regex.sub("|".join(sorted(s.DICTIONARY, key=len, reverse=True)), "", v.lower())
    ends = lambda p: bool(regex.search(p + r"\Z", b))
    return [
        min(len(v), 200),
        sum(c in "0123456789" for c in v) / n,
        sum(kind(c) == "u" for c in v) / n,
        sum(kind(c) == "l" for c in v) / n,
        sum((kind(x), kind(y)) in turn for x, y in zip(v, v[1:])) / n,
        known / n,
        1 - len(left) / n,
        sum(c in "aeiou" for c in v.lower()) / n,
        sum("g" <= c <= "z" for c in v.lower()) / n,
        max(1, len(set(v))) / min(n, 40),  # of nothing, one
        sum(c in "/._-" for c in v) + 2 * (b[-1:] in tuple("/.@")) + 2 * (a[:1] in tuple("/.@")),
        count(word(s.CUES), near),
        count(word(s.AGAINST), near) + count("example|sample|your|dummy|placeholder|changeme", v.lower()),
        int(ends(r"""[=:>]\s{0,8}["']?""")),
        int(bool(regex.match(f"(?:{s.PREFIXES})", v))) - len(regex.findall(r"((.)\2{4,})", v)) - count("1234|abcd", v),
        int(ends(s.ASSIGN)) + 2 * int(ends(s.BEARER) or (ends(s.URL) and a.startswith("@"))),
    ]


@pytest.mark.parametrize("words", [(), ("river", "hunter", "secret", "towns", "it's")])
def test_features(spark, words):
    r = random.Random(3)
    rows = [(x["v"], x["b"], x["a"]) for x in r.sample(s.labelled_findings(20, corpus=words), 400)]
    rows += [("", "", ""), ("Hunter-River_42", "password: ", " ok"), ("aaaaaabbbbbb1234abcd", 'Api-Key = "', '"'), ("über/é", "x://u:", "@h"), ("A" * 300, "bearer ", "/"), ("contraseña9", "contraseña=", ".")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, v string, b string, a string")
    got = df.select("i", F.expr("named_struct('v', v, 'b', b, 'a', a)").alias("c")).selectExpr("i", f"{s.features('c', words)} AS f").collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["f"] == pytest.approx(plain(*rows[x["i"]], set(words) or {""})), rows[x["i"]]
