"""Toxicity, language-model scoring, main text: exact parts and held-out accuracy."""

import itertools
import random
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import plain
import pytest
from llm_fixtures import frame, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from serialloom.llm import boosting, lm_scoring, main_text, toxicity
from serialloom.llm.dom import Page
from serialloom.llm.hidden_markov import Chain, Counts, log_likelihoods

# -- hidden Markov chain ------------------------------------------------------------------


def small_chain(seed=0):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(3), rng.random((3, 3)), rng.random((4, 3))
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def by_paths(chain, sequence):
    """(probability, expected start, moves, emissions) over all state paths."""
    total, start, move, emit = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=len(sequence)):
        p = chain.start[path[0]]
        for t, s in enumerate(sequence):
            p *= chain.emit[s, path[t]] * (chain.move[path[t - 1], path[t]] if t else 1)
        total += p
        start[path[0]] += p
        for t, s in enumerate(sequence):
            emit[s, path[t]] += p
            if t:
                move[path[t - 1], path[t]] += p
    return total, start / total, move / total, emit / total


@pytest.mark.parametrize("stretch", [2048, 2])
def test_forward_and_counts_are_those_of_all_paths(monkeypatch, stretch):
    monkeypatch.setattr("serialloom.llm.hidden_markov.STRETCH", stretch)
    chain, rng = small_chain(), np.random.default_rng(3)
    sequences = [rng.integers(0, 4, n).astype(np.int32) for n in (1, 5, 2, 6, 5, 0)]
    want = [by_paths(chain, s) for s in sequences if len(s)]
    got = log_likelihoods(chain, sequences)
    assert got[5] == 0 and np.allclose(got[:5], np.log([w[0] for w in want]))
    counts = Counts(3, 4)
    counts.add(chain, sequences)
    assert np.isclose(counts.log, got.sum())
    for k, part in enumerate((counts.start, counts.move, counts.emit), 1):
        assert np.allclose(part, sum(w[k] for w in want))


def test_long_sequences_of_many_lengths():
    chain, rng = small_chain(), np.random.default_rng(4)
    sequences = [rng.integers(0, 4, n).astype(np.uint16) for n in (3000, 1, 129, 128, 127, 700, 0, 2999)]

    def log_of(sequence):
        row, log = chain.start, 0.0
        for t, s in enumerate(sequence):
            row = (row @ chain.move if t else row) * chain.emit[s]
            log += np.log(row.sum())
            row = row / row.sum()
        return log

    assert np.allclose(log_likelihoods(chain, sequences), [log_of(s) for s in sequences], rtol=1e-12)
    counts, apart = Counts(3, 4), Counts(3, 4)
    counts.add(chain, sequences)
    for s in sequences:
        apart.add(chain, [s])
    assert np.isclose(counts.emit.sum(), sum(map(len, sequences)))
    for name in ("start", "move", "emit", "log"):
        assert np.allclose(getattr(counts, name), getattr(apart, name), rtol=1e-10)


class Watched(np.ndarray):
    looked_up = 0

    def __getitem__(self, at):
        Watched.looked_up += 1
        return np.asarray(self)[at]

    def take(self, at, axis=None):
        Watched.looked_up += 1
        return np.asarray(self).take(at, axis)


def test_emissions_are_looked_up_by_stretch_not_by_step():
    chain = small_chain()
    chain.emit = chain.emit.view(Watched)
    Watched.looked_up = 0
    Counts(3, 4).add(chain, [np.zeros(1000, np.int32)] * 3)
    assert 0 < Watched.looked_up <= 40


def test_probabilities_of_all_sequences_sum_to_one():
    every = [np.array(s, np.int32) for s in itertools.product(range(4), repeat=5)]
    assert np.isclose(np.exp(log_likelihoods(small_chain(), every)).sum(), 1)


def test_baum_welch_climbs():
    rng = np.random.default_rng(5)
    sequences = [np.concatenate([rng.integers(0, 2, 20), rng.integers(2, 4, 20)]).astype(np.int32) for _ in range(20)]
    frequency = np.full(4, 0.25)
    chain, logs = Chain.random(2, frequency), []
    for _ in range(15):
        counts = Counts(2, 4)
        counts.add(chain, sequences)
        logs.append(counts.log)
        chain = counts.chain(frequency, pull=0.01)
    assert all(b > a - 0.5 for a, b in itertools.pairwise(logs)) and logs[-1] > logs[0] + 100


# -- language model -----------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(20_000, 150_000), (20, 40)])
def test_lm_scores(frame, odd_docs, prose, monkeypatch, sizes):  # noqa: F811
    monkeypatch.setattr(lm_scoring, "SYMBOLS", sizes[0])
    monkeypatch.setattr(lm_scoring, "HELD", sizes[1])
    rows = [*odd_docs, (6, None), (6, None), *((100 + i, prose(60, 50 + i)) for i in range(40))]
    docs = frame(rows, "doc_id long, text string")
    learn = [t for d, t in rows if plain.remainder(d, 7) != 2]
    model = lm_scoring.train(docs.filter(lm_scoring.remainder(F.col("doc_id"), 7) != 2), passes=1)
    counts = Counter(w for t in learn for w in [*plain.words(t), ""])
    n, v = sum(counts.values()), len(counts)
    assert (model.vocabulary.total, model.vocabulary.distinct) == (n, v)
    text_of = {d: t for d, t in rows}
    got = lm_scoring.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens = [*plain.words(text_of[r.doc_id]), ""]
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert np.isclose(r.base_score, sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score < 0
    # exact: the chain's forward likelihood times each word's share of its class
    voc = model.vocabulary
    own = sorted(counts, key=lambda w: (-counts[w], w.encode()))[: sizes[0]]
    place = {w: i for i, w in enumerate(own)}
    mass = Counter()
    for w in counts:
        if w not in place:
            mass[lm_scoring.class_of(w.encode())] += counts[w] + 1
    for r in got[:12]:
        tokens = [*plain.words(text_of[r.doc_id]), ""]
        symbols = [place.get(w, voc.n_own + lm_scoring.class_of(w.encode())) for w in tokens]
        share = sum(
            log10((counts[w] + 1) / (mass[lm_scoring.class_of(w.encode())] + 1)) for w in tokens if w not in place
        )
        want = log_likelihoods(model.chain, [np.array(symbols, np.int32)])[0] / np.log(10) + share
        assert np.isclose(r.score, want)


def test_lm_words_of_many_texts_at_once(monkeypatch):
    texts = [" a\x0bB\x0c\x1cc ", None, "", "  ", "\u00c4b b\u00a0b\u2003c x" * 3, "a", "\n"] * 3
    want = [[*plain.words(t), ""] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    counts = Counter(w.encode() for t in want for w in t)
    for most in (400_000, 3):
        monkeypatch.setattr(lm_scoring, "COUNTED", most)
        got = Counter()
        for part in lm_scoring._count(batch.slice(i, 1) for i in range(len(texts))):
            for word, c in zip(*part.to_pydict().values(), strict=True):
                got[word] += c
        assert got == counts
    for n in (len(counts), 2, 0):
        held = counts.most_common(n)
        voc = lm_scoring.Vocabulary(held, {}, counts.total(), len(counts))
        symbols, places, bounds, rare = voc.encode_texts(batch.column("text"))
        known = {w for w, _ in held}
        for i, tokens in enumerate(want):
            mine = slice(bounds[i], bounds[i + 1])
            alone = voc.encode([w.encode() for w in tokens])
            assert symbols[mine].tolist() == alone[0].tolist() and places[mine].tolist() == alone[1].tolist()
            assert rare[i].as_py() == [w.encode() for w in tokens if w.encode() not in known]


def test_lm_beats_the_base_where_texts_differ_in_kind(frame):  # noqa: F811
    rng, rows = random.Random(2), []
    for i in range(300):
        kind = "abc"[i % 3]
        rows.append((i, " ".join(f"{kind}{int(rng.paretovariate(0.7))}" for _ in range(60))))
    docs = frame(rows, "doc_id long, text string")
    held = lm_scoring.remainder(F.col("doc_id"), 7) == 2
    model = lm_scoring.train(docs.filter(~held))
    sums = lm_scoring.score(docs.filter(held), model).agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > 0.95 * sums[1]


def test_lm_learns_from_all_texts_in_every_pass(frame):  # noqa: F811
    rng, rows = random.Random(4), [(None, None)] * 2000
    for i in range(150):
        kind = "abc"[i % 3]
        rows.append((i, " ".join(f"{kind}{rng.randrange(30)}" for _ in range(40))))
    rows += [(200 + i, "copy of one text") for i in range(600)]
    rng.shuffle(rows)
    model = lm_scoring.train(frame(rows, "doc_id long, text string"))
    voc = model.vocabulary
    sequences = [voc.encode([w.encode() for w in plain.words(t)] + [b""])[0] for _, t in rows]
    chain = Chain.random(lm_scoring.STATES, voc.frequency)
    for _ in range(14):
        counts = Counts(lm_scoring.STATES, len(voc.frequency))
        counts.add(chain, sequences)
        chain = counts.chain(voc.frequency)
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(model.chain, name), getattr(chain, name), rtol=1e-4, atol=1e-9)


def test_lm_of_nothing(frame):  # noqa: F811
    none = frame([], "doc_id long, text string")
    model = lm_scoring.train(none)
    assert lm_scoring.score(none, model).count() == 0
    row = lm_scoring.score(frame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row.n_tokens, row.n_known) == (3, 0) and np.isfinite(row.score)


# -- toxicity -----------------------------------------------------------------------------

BAD = ["grumblor", "snarfle", "vexatron", "dreckling"]


def toxic_rows(prose, n=400):  # noqa: F811
    rng, rows = random.Random(6), []
    for i in range(n):
        text = prose(rng.randint(10, 120), 300 + i).split()
        if i % 4 == 0:
            for _ in range(2 + len(text) // 40):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return rows


def test_toxicity_held_out_and_misspelt(frame, prose):  # noqa: F811
    rows = toxic_rows(prose)
    docs = frame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = frame([(d, y) for d, _, y in rows] + [(None, 1), (9999, None), (9998, 1)], "doc_id long, toxic int")
    learn = labels.filter(toxicity.remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, learn)
    y = {d: label for d, _, label in rows}
    right = [(r.score >= 0.5) == y[r.doc_id] for r in toxicity.score(docs, model).collect() if plain.remainder(r.doc_id, 5) == 0]
    assert np.mean(right) > 0.97
    more = [(1, "it is a grumblorr, snarfl and vexatr0n " + prose(30, 1)), (2, None), (3, ""), (4, " \n"), (5, prose(30, 2)), (5, prose(30, 2)), (6, "!!"), (7, "z" * 10**6)]
    got = {r.doc_id: r.score for r in toxicity.score(frame(more, "doc_id long, text string"), model).collect()}
    assert got[1] > got[5] and got[5] < 0.5 and got[2] == got[3] == got[4] == got[6] == 0 and 0 <= got[7] <= 1


def test_toxicity_without_labels(frame):  # noqa: F811
    docs, labels = frame([(1, "a b c")], "doc_id long, text string"), frame([], "doc_id long, toxic int")
    assert [r.score < 0.5 for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()] == [True]
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_bags_are_words_and_their_ngrams():
    buckets, owners = toxicity.bags([b"ab", b"c", "é".encode(), b"abcdefg"])
    # <ab>: itself, <ab ab> <ab>; <c>: itself, <c>
    assert np.bincount(owners).tolist() == [4, 2, 1 + 2 + 1, 1 + 7 + 6 + 5]
    alone, _ = toxicity.bags([b"abcdefg"])
    assert sorted(buckets[owners == 3]) == sorted(alone)


# -- main text ----------------------------------------------------------------------------


def text_of(html):
    page = Page(html)
    return page.text([True] * len(page.tags))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; <b>bo</b>ld", "plain & bold"),
        ("<p>a<p>b <br>c", "a b c"),
        ("<p>one\n\t two&nbsp;three</p>four", "one two three four"),
        ("<script>var t='</p>';<b>x</b></script>y<style>p{}", "y"),
        ("a<!-- <p>no</p> -->b", "ab"),
        ("<div title='a > b'>x</div><a href=\"u", "x"),
        ("1 < 2 <3 & 3 > 2", "1 < 2 <3 & 3 > 2"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<title>t</title><body>x</body></html>y</div>", "x y"),
        ("&#x41;&eacute;&bogus;", "Aé&bogus;"),
    ],
)
def test_dom_text(html, text):
    assert text_of(html) == text


def test_decode_never_contradicts():
    page = Page("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    rng = np.random.default_rng(1)
    for _ in range(200):
        margins = rng.normal(0, 2, len(page.tags))
        kept = main_text.decode(page, margins)
        options = [
            k for k in itertools.product([False, True], repeat=len(page.tags))
            if k[0] and all(not k[i] or k[page.parents[i]] for i in range(1, len(k)))
        ]
        value = lambda k: sum(m for m, on in zip(margins[1:], k[1:], strict=True) if on)
        assert np.isclose(value(kept), max(map(value, options)))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = boosting.fit(x[:3000], y[:3000], rounds=30, share=1.0)
    assert np.mean((trees.margins(x[3000:]) > 0) == y[3000:]) > 0.97


@pytest.fixture(scope="module")
def natural(prose):  # noqa: F811
    def page(i):
        said = [prose(12 + (7 * i + k) % 60, 10 * i + k) for k in range(1 + i % 5)]
        links = "".join(f"<li><a href='/{k}'>{prose(1, k)}</a></li>" for k in range(6))
        html = (
            f"<html><head><title>{prose(4, i)}</title><style>p{{}}</style></head><body><nav><ul>{links}</ul></nav>"
            f"<div class='ad'>{prose(9, i + 1)}</div><article><h1>{prose(5, i)}</h1>"
            + "".join(f"<p>{s}</p>" for s in said) + f"</article><footer>&copy; {prose(6, i + 2)}</footer></body></html>"
        )
        return html, " ".join([prose(5, i), *said])

    return [page(i) for i in range(160)]


def test_main_text_held_out(frame, natural):  # noqa: F811
    trees = main_text.fit([h for h, _ in natural[:80]], layouts=300)
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(natural[80:])] + [(500, None, None), (501, "u", ""), (502, "u", natural[0][0])] * 2
    got = main_text.main_text(frame(rows, "page_id long, url string, html string"), trees)
    assert got.columns == ["page_id", "url", "text"]
    texts = [(r.page_id, r.text) for r in got.collect()]
    assert len(texts) == len(rows)
    assert all(t == "" for i, t in texts if i in (500, 501))
    right = [t == natural[80 + i][1] for i, t in texts if i < 80]
    assert np.mean(right) > 0.95
    rng, prose_texts = np.random.default_rng(77), [t for _, t in natural]
    wanted, found = Counter(), Counter()
    both = 0
    for _ in range(80):
        html = main_text._Layout(rng, prose_texts).page()
        page = Page(html)
        inside = main_text._inherited(page)
        want = Counter(page.text([i in inside for i in range(len(page.tags))]).split())
        have = Counter(main_text.extract([html], trees)[0].split())
        wanted += want
        found += have
        both += sum((want & have).values())
    assert both / sum(wanted.values()) > 0.95 and both / sum(found.values()) > 0.95


def test_main_text_of_nothing(frame):  # noqa: F811
    none = frame([], "page_id long, url string, html string")
    assert main_text.main_text(none, main_text.train(none)).count() == 0


@pytest.mark.parametrize("name", ["button", "select", "canvas", "object", "noscript", "template"])
def test_an_element_without_an_end_tag_drops_no_article(name):
    def said(html):
        page = Page(html)
        return page.text([True] * len(page.tags))

    article = "<article><h1>Head</h1><p>The words.</p></article>"
    for menu in (f"<nav><{name}>Menu</nav>", f"<{name}>Menu", f"<div><{name}>Menu <{name}>Close</{name}></div>"):
        assert said(f"<body>{menu}{article}<footer><{name}>Top</{name}> End</footer></body>") == "Head The words. End"
        assert said(f"<body>{menu}{article}</body>") == "Head The words."
    assert said(f"<p>a</p><{name}><b>no <i>word</i></b></{name}><p>b</p>") == "a b"


def test_text_of_math_is_kept():
    page = Page("<article><p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> holds<svg><g><path/></g></svg>.</p></article>")
    assert page.text([True] * len(page.tags)) == "so x=1 holds."
    page = Page("<p>a <button><div>no</div></button> b</p><math><mi>y</mi><p>c</p>")
    assert page.text([True] * len(page.tags)) == "a b y c"
