"""Spelling variants, licence scans and ranked search against brute force and edge cases."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from orbitlake.llm import license_scan, ranked_search, spelling
from orbitlake.llm.textscan import TermBlock, blocks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, word string, n long, score double, rank string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def terms(text):
    return [lower(t) for t in TERM.findall(text or "")]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    say = lambda n, v: " ".join(f"term{int(i)}" for i in rng.zipf(1.3, n) % v)
    rows = [(i, say(int(rng.integers(1, 90)), 300)) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(70)]  # ties
    rows += [(2000, "TERM1 Term1 term1"), (2001, ""), (2002, None), (2003, " \n,;"), (2004, "Çédille naïve 日本 ÀB"), (2005, say(40000, 50)), (3, rows[3][1]), (None, rows[7][1]), (None, None), (-5, rows[7][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "x", 1, 0.5, "y") for i, t in corpus], SCHEMA).repartition(5).cache()


# Spelling variants


def brute_variants(counts, ratio=5):
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found, form = {}, {}
    for w, n in counts.items():
        mine = [v for v in counts if near(w, v)]
        best = min(mine, key=lambda v: (-counts[v], v.encode()), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
        found[w] = len(mine)
    rows = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, found[w], counts[form[w]] if w in form else None))
    return rows


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_variants_against_all_pairs(spark, monkeypatch, bits):
    """Also with a filter of 64 bits, which passes nearly everything: the join alone decides."""
    monkeypatch.setattr(spelling, "MOST_BITS", bits)
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abß日"), int(rng.integers(1, 7)))) for _ in range(400)} | {"aaaaaaaa", "aaaaaaa", "b", "x" * 3000, "x" * 1500 + "y" + "x" * 1499, "x" * 2999}
    counts = {w: int(5 ** rng.integers(0, 6)) * int(rng.integers(1, 3)) for w in sorted(words)}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, root long").repartition(3)
    got = spelling.spelling_variants(df).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == brute_variants(counts)
    assert any(r["form"] is not None and r["root"] != r["form"] for r in got)


def test_neighbourhoods_are_whole_and_distinct():
    everything = spelling.Filter(np.full(4, np.iinfo(np.uint64).max, np.uint64), 8)
    alphabet = np.array(sorted(map(ord, "abc")), np.uint64)
    for word in ("a", "ab", "aab", "cccc", "abcabc"):
        made = [m for _, strings in spelling.neighbourhood([word], alphabet, everything) for m in strings]
        edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
        edits |= {word[:i] + c + word[i + k :] for c in "abc" for k in (0, 1) for i in range(len(word) + 1 - k)} - {word}
        assert len(made) == len(set(made)) and set(made) == edits, word


def test_variants_of_odd_rows(spark):
    rows = [("word", 10), ("word", 5), ("wordy", 1), (None, 3), ("", 4), ("alone", None)]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got) == {"word", "wordy"} and got["word"]["n"] == 15 and got["wordy"]["form"] == "word" and got["word"]["form"] is None
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long"), ratio=1)


def test_planted_words(spark, docs, corpus):
    rows = [(i, t * 3) for i, t in corpus if t] + [(k, "Straßenbahn naïvement ÀÉÎÕÜabc") for k in range(600)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, run string").repartition(3)
    expected = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            word = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 6:
                expected[word] += 1
    got = {r["word"]: r["n"] for r in spelling.planted_words(df).collect()}
    assert got == {w: n for w, n in expected.items() if n >= 5} and "straßenbahn" in got and len(got) >= 3
    assert spelling.planted_words(docs.limit(0)).count() == 0


# Licence scans


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        templates = [[*map(str, rng.integers(0, 3, int(rng.integers(1, 9))))] for _ in range(4)]
        made = license_scan.Automaton.of(templates)
        text = [*map(str, rng.integers(0, 4, 60))]
        state = length = 0
        for i, word in enumerate(text):
            state, length = made.step(state, length, word)
            places = {(t, e): max((n for n in range(1, e + 1) if text[max(0, i + 1 - n) : i + 1] == tpl[e - n : e]), default=0) for t, tpl in enumerate(templates) for e in range(1, len(tpl) + 1)}
            places = {k: n for k, n in places.items() if n}
            assert length == max(places.values(), default=0)
            assert {k: min(n, length) for k, n in made.ends[state].items()} == places


def test_phrases_of_all_shapes(spark):
    rng = np.random.default_rng(4)
    phrases = {"a b": "ab", "a b c": "abc", "b": "b", "c c": "cc", "b c c a": "long"}
    texts = [" ".join(rng.choice(list("abcd"), int(rng.integers(0, 50)))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    for r in license_scan.scan_licenses(df, phrases=phrases, notices={}).collect():
        words = r["text"].split()
        expected = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert [(p["start"], p["label"]) for p in r["phrases"]] == expected and r["score"] == float(bool(expected)) and not r["spans"]


def test_chain_against_all_chains():
    rng = np.random.default_rng(6)

    def total(part):
        covered, (end, place) = part[0][2], part[0][:2]
        for e, p, n in part[1:]:
            over = max(0, end - (e - n), place - (p - n))
            if over >= n or place >= p or e - n - end > 24:
                return -1
            covered, end, place = covered + n - over, e, p
        return covered

    for _ in range(60):
        matches = sorted({(int(e), int(rng.integers(4, 30)), int(rng.integers(1, 5))) for e in rng.integers(5, 70, 7)})
        best = max(total(part) for k in range(1, len(matches) + 1) for part in itertools.combinations(matches, k))
        assert max(c[0] for c in license_scan.chains(matches)) == best


def test_notices(spark):
    mit, gpl = license_scan.NOTICES["mit-notice"][0], license_scan.NOTICES["gpl-3.0"][0]
    words = mit.split()
    edited = " ".join([*words[:12], "some", "more", *words[12:30], "CHANGED", *words[31:]])
    rows = {
        "whole": f"Foo bar.\n{mit}\nBaz",
        "edited": f"# {edited.upper()} #",
        "half": " ".join(words[: len(words) // 2]),
        "two": f"{gpl} and then something else altogether, in its own words, for long enough {mit}",
        "line": "This work is licensed under the GNU General Public License, version 3.",
        "many": "Released under the MIT License. " * 3000,
        "none": "the software is free and it can be used for any purpose",
        "empty": "",
        "null": None,
    }
    df = spark.createDataFrame([(k, t, "clash", 1.0) for k, t in rows.items()], "k string, text string, spans string, SCORE double").repartition(3)
    got = {r["k"]: r for r in license_scan.scan_licenses(df).collect()}
    labels = {k: [s["label"] for s in r["spans"]] for k, r in got.items()}
    assert labels["whole"] == ["mit-notice"] and got["whole"]["spans"][0]["start"] == 2 and got["whole"]["score"] == 1.0
    assert labels["edited"] == ["mit-notice"] and 0.9 < got["edited"]["spans"][0]["covered"] < 1
    assert labels["half"] == [] and 0.3 < got["half"]["score"] < 0.8
    assert labels["two"] == ["gpl-3.0", "mit-notice"] and labels["line"] == ["gpl-3.0"] and labels["none"] == []
    assert labels["many"] == ["mit-notice"] * 3000 and len(got["many"]["phrases"]) == 3000
    for k in ("empty", "null"):
        assert (got[k]["n_words"], got[k]["phrases"], got[k]["spans"], got[k]["score"]) == (0, [], [], 0.0)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(df, phrases={"...": "x"})


def test_license_base(docs, corpus):
    """Counts and base places of the contract's query on rows with nulls, ties and long texts."""
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"]) for r in license_scan.scan_licenses(docs).filter("doc_id IS NOT NULL").collect())
    assert got == sorted((False, i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))) for i, t in corpus if i is not None)


# Ranked search


def brute_ranks(corpus, items, k):
    held = [(i, Counter(terms(t))) for i, t in corpus]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    rows = []
    for item, mine in asked.items():
        scored = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in mine if t in c)
            scored.append((-score, i is None, i or 0, i))
        rows += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(rows, key=str)


ITEMS = [(1, "Term1, term2; TERM17"), (2, "term5"), (3, None), (4, "nothing of this"), (5, " ".join(f"term{i}" for i in range(300))), (6, "naïve çédille 日本 term9"), (7, "term40 term41"), (7, "term42 term1"), (None, "term3 term4")]


@pytest.mark.parametrize(("k", "block", "postings", "frontier"), [(50, 4 << 20, 1 << 20, 1 << 14), (7, 64, 300, 5), (1, 4 << 20, 50, 64)])
def test_search_against_scores_of_all(spark, docs, corpus, monkeypatch, k, block, postings, frontier):
    """Also with many blocks of items, small treaps and small frontiers."""
    for name, value in (("ITEM_BYTES", block), ("POSTINGS", postings), ("FRONTIER", frontier), ("PAIRS", 500 if k == 7 else 4 << 20)):
        monkeypatch.setattr(ranked_search, name, value)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank long")
    got = [tuple(r) for r in ranked_search.ranked_search(docs, items, k).collect()]
    assert sorted(got, key=str) == brute_ranks(corpus, ITEMS, k)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0


def test_treaps_are_treaps_and_prune():
    rng = np.random.default_rng(8)
    n_docs, n_terms = 3000, 40
    term, doc = np.divmod(np.sort(rng.choice(n_terms * n_docs, 30000, replace=False)), n_docs)
    impact = rng.zipf(1.5, len(term)).clip(max=1000).astype(np.int64)
    treaps = ranked_search.Treaps.build(term, doc, impact, n_docs, n_terms)
    for t in range(n_terms):
        seen, waiting = [], [(treaps.root[t], -1, n_docs, np.inf)]
        while waiting:
            node, lo, hi, above = waiting.pop()
            if node < 0:
                continue
            assert term[node] == t and lo < doc[node] < hi and impact[node] <= above
            seen.append(node)
            waiting += [(treaps.left[node], lo, doc[node], impact[node]), (treaps.right[node], doc[node], hi, impact[node])]
        assert sorted(seen) == np.flatnonzero(term == t).tolist()
    items = np.stack([rng.choice(n_terms, 3, replace=False) for _ in range(20)]).astype(np.int32)
    best = ranked_search.Best(len(items), 5)
    looked = ranked_search.traverse(treaps, items, np.arange(n_docs), best)
    dense = np.zeros((n_terms, n_docs), np.int64)
    dense[term, doc] = impact
    for i, mine in enumerate(items):
        scores = dense[mine].sum(0)
        order = np.lexsort((np.arange(n_docs), -scores))[:5]
        assert best.doc[best.item == i].tolist() == order.tolist() and best.score[best.item == i].tolist() == scores[order].tolist()
    assert looked < len(items) * n_docs / 4


def test_terms_are_those_of_the_pattern(corpus):
    for b in blocks(pa.array([t for _, t in corpus]), kind=TermBlock):
        for at in range(len(b)):
            words = range(b.word_bounds[at], b.word_bounds[at + 1])
            assert [bytes(b.data[b.starts[w] : b.ends[w]]).decode() for w in words] == terms(corpus[b.lo + at][1])
