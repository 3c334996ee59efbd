"""The audit against plain Python on odd rows, and cut into small blocks."""

import re
from collections import Counter, defaultdict

import pytest

from faresight.llm import divergence
from tests.llm.conftest import odd_texts


def expected(docs, min_docs, top):
    """docs: (text, lang, source)"""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        count[lang, source].update(w)
        df[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        held = {s: Counter({t: count[lang, s][t] for t in kept}) for s in sources}
        whole = sum(held.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (n + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in held.items()}, share(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if held[s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(rows[:most])]
    return sorted(out)


def run(df, *args):
    return sorted(tuple(r) for r in divergence.audit(df, *args).collect())


def test_odd_rows(odd_docs, no_docs):
    texts = [(r[1], r[2], r[3]) for r in odd_texts()]
    assert run(odd_docs, 2, 3) == expected(texts, 2, 3)
    assert run(odd_docs, 10**6) == expected(texts, 10**6, 50)       # no kept terms: pairs of value 0
    assert run(no_docs) == []


@pytest.fixture(scope="module")
def many(spark):
    import random
    r = random.Random(5)
    rows = []
    for i in range(400):
        text = " ".join(r.choice("ab cd Ef gh ij é 日本 kl".split()[r.randrange(3):]) for _ in range(r.randrange(12)))
        rows += [(text, r.choice("xxy"), f"s{r.randrange(9)}")] * r.choice([1, 1, 1, 30])
    return rows, spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)


def test_copies_ties_and_blocks(many, monkeypatch):
    rows, df = many
    want = expected(rows, 30, 4)
    assert run(df, 30, 4) == want
    for name, value in (("TILE", 2), ("ENTRIES", 5), ("CELLS", 9), ("HELD", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert run(df, 30, 4) == want


def test_texts_are_tokenized_once(many):
    rows, df = many
    got = divergence.collapse(df).collect()
    assert len(got) == len({(x[1], x[0]) for x in rows})
    assert Counter({(r["lang"], r["text"], c["source"]): c["n"] for r in got for c in r["copies"]}) == Counter(
        (lang, text, source) for text, lang, source in rows)


def test_exact_beyond_64_bits(spark):
    n = 10**13 + 7
    df = spark.createDataFrame([(n, 3 * n, 11)], "n long, total long, kept long")
    assert df.select(divergence._share("n", "total", "kept")).first()[0] == 1 + (10**9 * (n + 5)) // (3 * n + 55)
