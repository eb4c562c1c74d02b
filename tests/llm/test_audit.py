"""Spelling variants, source divergence and quality rules against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import plain
import pytest
from conftest import values
from llm_fixtures import frame, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from serialloom.llm import divergence, quality, spelling

# --- spelling variants -------------------------------------------------------


def plain_words(docs, least=7):
    said = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(plain.A_Z)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                said[run] += 1
    return said


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


STEMS = "bananas elephant understand understood undertake wandering überläuft façades aaaaaaa aaaaaaaa abababab".split()


@pytest.fixture(scope="module")
def typed():
    """Words with a few edits each, of very different counts."""
    import random

    rng, said = random.Random(5), {}
    for stem in STEMS:
        for k in range(40):
            word = list(stem)
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                at = rng.randrange(len(word))
                word[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "é", "a"])
            if len(word) >= 7:
                said["".join(word)] = rng.choice([2, 3, 20, 30, 250, 4000])
    return said


@pytest.mark.parametrize("crowd", [256, 3, 0])
def test_variants(frame, typed, crowd):
    got = spelling.spelling_variants(frame(list(typed.items()), "word string, n long", extra=("form", "size")), crowd=crowd)
    assert values(got, "word", "form", "root", "n", "n_near", "form_n") == plain_variants(typed)


def test_words(frame, odd_docs):
    docs = [*odd_docs, (None, "Überraschung, ÜBERraschung; Zwölfer×zwölfer1überall"), (21, "Ab" * 60_000 + " abababab")]
    got = spelling.count_words(frame(docs, "doc_id long, text string", extra=("word", "n")))
    assert values(got, "word", "n") == sorted(plain_words(docs).items(), key=repr)
    assert spelling.count_words(frame([], "doc_id long, text string")).count() == 0


def test_a_run_loses_a_code_point(frame):
    docs = [(i, f"grandmother grandmother{i % 3} GRANDMOTHER") for i in range(300)]
    expected = plain_words(docs)
    assert len(expected) > 3
    assert values(spelling.count_words(frame(docs, "doc_id long, text string")), "word", "n") == sorted(expected.items())


def test_variants_of_nothing(frame):
    assert spelling.spelling_variants(frame([], "word string, n long")).count() == 0
    alone = spelling.spelling_variants(frame([("lonesome", 3)], "word string, n long"))
    assert values(alone, *alone.columns) == [("lonesome", None, "lonesome", 3, 0, None)]


def test_rows_made_of_words_are_not_broadcast(frame, typed):
    """A small table of words is many chunks and grams, whatever its size on disk."""
    pairs = spelling.near_words(spelling.pin(frame([(w,) for w in typed], "word string")))
    assert pairs.count()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    verified = [line for line in plan.splitlines() if "levenshtein" in line]
    assert len(verified) == 2 and all("SortMergeJoin" in line for line in verified), plan


# --- source divergence -------------------------------------------------------


def plain_divergence(docs, least, top=50):
    """Rows (text, lang, source)."""
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(plain.A_Z))
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in in_docs:
        kept = [t for t, k in in_docs[lang].items() if k >= least]
        sources = [s for g, s in counts if g == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(said, kept=kept):
            total = sum(said[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (said[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def sourced(prose):
    docs = []
    for i in range(160):
        text = prose(30 + i % 40, i)
        docs.append((text, ["aa", "bb", None, ""][i % 4], [None, "x", "y", "Z", "é", "字", "src10", "src9"][i % 7]))
    docs += [(None, "aa", "empty"), ("", "dd", "only"), ("...", "dd", None), ("Once", "ee", "alone")]
    docs += [("Équipe zürich ÉQUIPE", "aa", "x")] * 40
    return docs


SCHEMA = "text string, lang string, source string"
REPORT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("least, top", [(5, 50), (30, 3), (1, 2000)])
def test_divergence(frame, sourced, least, top):
    docs = frame(sourced, SCHEMA, extra=("term", "n", "value", "rank", "place", "doc_id"))
    got = divergence.divergence(docs, least_docs=least, top=top)
    assert values(got, *REPORT) == plain_divergence(sourced, least, top)


def test_pairs_in_blocks_and_slices(frame, sourced):
    kept = divergence.Kept(divergence.pin(divergence.count_terms(frame(sourced, SCHEMA))), 5)
    got = divergence.source_pairs(kept, block=2, per_slice=7).withColumn("part", F.lit("pair"))
    assert values(got, *REPORT) == [r for r in plain_divergence(sourced, 5) if r[2] == "pair"]


def test_counts_are_passed_on(frame, sourced, monkeypatch):
    whole = values(divergence.count_terms(frame(sourced, SCHEMA)), "lang", "source", "term", "n", "docs")
    batches = frame(sourced, SCHEMA).coalesce(1).toArrow().to_batches()
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    parts = Counter()
    for batch in divergence._counted(batches):
        for row in batch.to_pylist():
            parts[row["lang"], row["source"], row["term"]] += row["n"]
    # null and '' are one group only for the whole operator, which replaces nulls first
    assert {k: n for (*k, n) in ((r[0], r[1], r[2], r[3]) for r in whole) for k in [tuple(k)]} == dict(parts)


def test_shares_are_exact(spark):
    big = 9 * 10**17
    rows = spark.createDataFrame([(big, big, 10), (0, big, 1), (3, 7, 4)], "n long, total long, terms long")
    got = values(rows.select("n", divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "n", "p")
    expected = [(n, 1 + 10**9 * (n + 5) // (t + 5 * v)) for n, t, v in [(big, big, 10), (0, big, 1), (3, 7, 4)]]
    assert got == sorted(expected, key=repr)


def test_divergence_of_nothing(frame):
    assert divergence.divergence(frame([], SCHEMA)).count() == 0


# --- quality rules -----------------------------------------------------------


def plain_base(text):
    text = text or ""
    said = [w for w in plain.SPACE.split(text) if w]
    windows = [tuple(said[i : i + 8]) for i in range(len(said) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if plain.SPACE.sub("", x)]
    failed = len(said) < 20 or 100 * len(covered) > 30 * len(said)
    symbols = len(re.findall("[#*$%&|<>]", text))
    return len(said), sum(map(len, said)), symbols, len(lines) - len(set(lines)), len(covered), failed


CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[.,;:!?'\"()-]", "[\x00-\x7f]")


def plain_classes(text):
    out, rest = [], plain.SPACE.sub("", text or "")
    for one in CLASSES:
        left = re.sub(one, "", rest)
        out.append(len(rest) - len(left))
        rest = left
    return [*out, len(rest)]


def plain_distance(one, other):
    p, q = ([n / max(1, sum(h)) for n in h] for h in (one, other))
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))


def plain_quality(docs, common=32, least=2000):
    """Rows (doc_id, text, lang) -> base counts, class_distance, common_distance."""
    known = {}
    for lang in {g for _, _, g in docs if g is not None}:
        said, classes = Counter(), [0] * 6
        for _, text, g in docs:
            if g == lang:
                said.update(w for w in plain.SPACE.split(text or "") if w)
                classes = [a + b for a, b in zip(classes, plain_classes(text), strict=True)]
        if sum(said.values()) >= least:
            best = sorted(said, key=lambda w: (-said[w], w.encode()))[:common]
            known[lang] = (classes, best, [*(said[w] for w in best), sum(said.values()) - sum(said[w] for w in best)])
    out = []
    for doc_id, text, lang in docs:
        base, far = plain_base(text), [None, None]
        if lang in known:
            classes, best, counts = known[lang]
            said = Counter(w for w in plain.SPACE.split(text or "") if w)
            if base[1] >= 200:
                far[0] = plain_distance(plain_classes(text), classes)
            if base[0] >= 100:
                mine = [said[w] for w in best]
                far[1] = plain_distance([*mine, base[0] - sum(mine)], counts)
        out.append((doc_id, *base, *far))
    return sorted(out, key=repr)


QUALITY = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed class_distance common_distance".split()


@pytest.fixture(scope="module")
def judged(prose):
    docs = [(i, "the of the " + prose(150, i) + " and the", "en") for i in range(30)]
    docs += [(100, "a b c d e f g h " * 30, "en"), (101, "x " * 19, "en"), (102, None, "en"), (103, "", None)]
    docs += [(104, "same line\n\nsame line\n same line\n \nlast", "en"), (105, "*** $$ |" * 200, "en")]
    docs += [(106, "##!!## " * 9 + " ".join(f"|{i}|%" for i in range(150)), "en"), (107, prose(200, 7), "rare")]
    docs += [(None, "the of the " + prose(150, 3) + " and the", None), (5, "the of the " + prose(150, 5) + " and the", "en")]
    long_text = prose(30_000, 2)
    docs += [(108, long_text, "en"), (109, long_text + "\n" + long_text, "xx"), (110, "é ü 字 " * 100, "xx")]
    docs += [(111, "w" * 300_000, "en"), (112, "one two three four five six seven eight nine " * 3, "en")]
    return docs


def test_quality(frame, judged):
    docs = frame(judged, "doc_id long, text string, lang string", extra=("quality_", "words", "counts", "classes", "n_words"))
    found = quality.quality(docs, quality.references(docs))
    got = values(found, "doc_id", *[f"quality.{c}" for c in QUALITY])
    expected = plain_quality(judged)
    assert [r[:7] for r in got] == [r[:7] for r in expected]
    assert len(got) == len(judged)
    for mine, other in zip(got, expected, strict=True):
        assert mine[7:] == pytest.approx(other[7:], abs=1e-9)
    kept = {r[0]: r[1] for r in values(found, "doc_id", "quality.kept")}
    assert all(kept[i] for i in range(30)) and not any(kept[i] for i in (100, 101, 102, 105, 106))
    assert {"n_words", "classes", "text"} <= set(found.columns)


def test_quality_of_nothing(frame):
    none = frame([], "doc_id long, text string, lang string")
    assert quality.references(none).count() == 0
    assert quality.quality(none, quality.references(none)).count() == 0
