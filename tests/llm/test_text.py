"""Decontamination, packing, chat formatting, URL rules, language and tokens."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import groupby
from types import SimpleNamespace

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest import values
from llm_fixtures import frame, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from serialloom.llm import chat_format, decontamination, language_id, packing, url_filter
from serialloom.llm.tokens import default_path, encoder

ITEMS = [(1, "Alpha beta gamma"), (2, None), (3, ""), (4, "..."), (None, "delta"), (1, "one two three")]


@pytest.mark.parametrize("most", [200_000, 5])
def test_contamination(frame, odd_docs, prose, most):
    items = [*ITEMS, (10, " ".join(prose(60, 1).split()[20:50])), (11, " ".join(prose(60, 1).split()[25:40]).upper())]
    docs = [*odd_docs, (30, "alpha, BETA; gamma delta delta x"), (31, "delta"), (31, "delta"), (None, "alpha beta gamma")]
    found = decontamination.contamination(
        frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), most_windows=most
    )
    got = decontamination.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated"
    )
    assert values(got, *got.columns) == sorted(plain.contamination(docs, items), key=repr)


def test_contamination_of_nothing(frame):
    docs, none = frame([(1, "a b")], "doc_id long, text string"), frame([], "item_id long, text string")
    found = decontamination.judged(decontamination.contamination(docs, none))
    assert values(found, "doc_id", "n_words", "n_hit") == [(1, 2, 0)]
    assert decontamination.contamination(frame([], "doc_id long, text string"), none).count() == 0


def test_remove_spans(frame):
    docs = frame([(1, "Ä x, alpha-BETA\ngamma! end"), (2, "keep"), (3, None)], "row_id long, text string")
    docs = docs.withColumn("doc_id", F.col("row_id"))
    found = decontamination.contamination(docs, frame(ITEMS, "item_id long, text string"), row_id="row_id")
    assert values(decontamination.remove_spans(docs, found), "row_id", "text") == [(1, "Ä x, ! end"), (2, "keep"), (3, "")]


def simulate(counts, rows):
    """Sequences as the plan fills them: {sequence: [(offset, length)]}."""
    places = {}
    for size, first, last, sequence, each, offset in rows:
        for k in range(last - first):
            places.setdefault(sequence + k // each, []).append((offset + k % each * size, size))
    return places


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 65))
    counts = np.concatenate([[0], rng.poisson(rng.uniform(0, 6, capacity) ** 2)])
    places = simulate(counts, packing.plan(counts))
    assert sorted(s for p in places.values() for _, s in p) == sorted(np.repeat(np.arange(capacity + 1), counts).tolist())
    for placed in places.values():
        at = 0
        for offset, size in sorted(placed):
            assert offset == at
            at += size
        assert at <= capacity
    assert sorted(places) == list(range(len(places)))
    total = int((counts * np.arange(capacity + 1)).sum())
    assert len(places) <= 1.2 * -(-total // capacity) + 2


def test_two_replace_the_smallest():
    counts = np.zeros(11, int)
    counts[[7, 2, 3]] = [1, 1, 0]
    assert len({r[3] for r in packing.plan(counts)}) == 1
    counts = np.zeros(11, int)
    # 6 + 3 leaves a gap of 1; 2 + 2 in place of the 3 fill it, and the 3 goes elsewhere
    counts[[6, 3, 2]] = [1, 1, 2]
    first = [(r[0], r[4]) for r in packing.plan(counts) if r[3] == 0]
    assert first == [(6, 1), (2, 2)]


def test_texts_leave_a_task_in_small_batches(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    text = "some plain words " * 20_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([text] * 12)], ["doc_id", "text"])
    parts = list(packing._cut(packing.default_path(), packing.END_ID, packing.CAPACITY)([batch]))
    assert [len(set(p.column("doc_id").to_pylist())) for p in parts] == [3, 3, 3, 3]
    never = SimpleNamespace(value=language_id.Model([], None, None, None, 0.0))
    assert len(list(language_id._accepted(never, "text")([batch]))) == 4


def test_packing(frame, odd_docs):
    docs = [*odd_docs, (None, "again"), (None, "again"), (40, "word " * 1022 + "word"), (41, "word " * 5000)]
    pieces = packing.token_pieces(frame(docs, "doc_id long, text string"))
    from serialloom.plans.pin import pin

    pieces = pin(pieces)
    enc = encoder(default_path())
    whole = sorted((d, zlib.crc32(enc.tokenizer.encode(t or "", add_special_tokens=False).ids.__repr__().encode())) for d, t in docs if d is not None)
    ids = {}
    for r in sorted(pieces.filter("doc_id IS NOT NULL").collect(), key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(ids.get(r.doc_id, b"")) // 4 and 1 <= r.length <= 1024 and len(r.ids) == 4 * r.length
        assert r.piece == 0 or r.length == 1024
        ids[r.doc_id] = ids.get(r.doc_id, b"") + r.ids
    said = sorted((d, zlib.crc32(np.frombuffer(x[:-4], "<u4").tolist().__repr__().encode())) for d, x in ids.items())
    assert said == whole and all(x[-4:] == b"\2\0\0\0" for x in ids.values())
    rows = packing.pack(pieces.drop("ids")).collect()
    assert len(rows) == pieces.count()
    for _, group in groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 1024) + 2
    assert packing.packed_digest(frame([], "doc_id long, text string")).count() == 0


def test_encoder_is_the_tokenizer(prose):
    enc, untouched = encoder(default_path()), Tokenizer.from_file(default_path())
    texts = [prose(200, 5), "  two  spaces \n\n", "<|endoftext|> x", "it's 12é 字\u3000 \x1f", " " * 30, "\n", "a" * 600_000]
    for text in texts:
        ids = untouched.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids
        plain_ids = np.frombuffer(enc.encode_plain(text), "<u4").tolist()
        assert b"".join(enc.bytes_of[i] for i in plain_ids) == text.encode()
        assert plain_ids == ids or "<|endoftext|>" in text
    assert np.frombuffer(enc.encode("hello <|endoftext|> x"), "<u4").tolist() == [31373, 220, 50256, 2124]


HARD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<<s>s>", "", "plain é\n", "[ROLE]x[TEXT]", "\\</s>", "<|endoftext|>"]


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.CONTROLS)


def test_chats(frame, spark):
    rows = [(c, t, ["user", "assistant", "system", "tool", None][t % 5], HARD[(c + t) % len(HARD)]) for c in range(9) for t in range(7)]
    rows += [(50, 0, "assistant", None), (None, 1, "user", "b"), (None, None, "assistant", "a"), (60, 1, "user", "x"), (60, 1, "user", "x")]
    made = chat_format.format_chats(frame(rows, "conv_id long, turn long, role string, text string"))
    enc = encoder(default_path())
    expected = {}
    for conv, turn, role, text in rows:
        expected.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = made.collect()
    assert len(got) == len(expected)
    for r in got:
        want = [(role, text) for *_, role, text in sorted(expected[r.conv_id])]
        turns, loss = chat_format.read_back(enc, r.ids, r.mask)
        assert turns == want and r.n_turns == len(want)
        assert loss == "".join(text for role, text in want if role == "assistant")
        assert len(r.mask) * 4 == len(r.ids)
    assert chat_format.format_chats(frame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_masks_are_prefix_sums_over_spliced_segments():
    enc = encoder(default_path())
    turns = [("user", "a b"), ("assistant", "c </s> d"), ("tool", "x"), ("assistant", ""), ("assistant", "end")]
    segments = [chat_format.segment(enc, *t) for t in turns]
    ids, mask, _ = chat_format.assemble(enc, turns)
    parts = [chat_format.spliced(enc, [s[:3] for s in segments[a:b]], a == 0) for a, b in ((0, 2), (2, 3), (3, 5))]
    assert b"".join(p for p, _ in parts) == ids and b"".join(m for _, m in parts) == mask
    values_ = np.frombuffer(ids, "<u4")
    under = [bool(m) for m in mask]
    said = [t for r, t in turns if r == "assistant"]
    assert sum(under) == sum(len(enc.encode_plain(chat_format.escape(t))) // 4 for t in said)
    assert not any(u for u, v in zip(under, values_.tolist(), strict=True) if v >= enc.size)


def test_a_conversation_in_many_slices(spark, tmp_path, monkeypatch):
    rows = [(1, t, ["user", "assistant", "tool"][t % 3], f"{HARD[t % len(HARD)]} {t} " * 50) for t in range(400)]
    rows += [(None, 5, "assistant", "late"), (None, None, "user", None), (2, 3, "assistant", "b"), (2, 3, "assistant", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(chat_format, "by_size", lambda batches, column="text": (b.slice(i, 7) for b in batches for i in range(0, len(b), 7)))
    got = {r.conv_id: r for r in chat_format.op8_chat_format(spark, str(tmp_path)).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t is not None, t or 0, r, x or "") for c, t, r, x in rows if c == conv))
        digest = sha256("".join(f"{r}\n{x}\n" for *_, r, x in mine).encode()).hexdigest()
        loss = "".join(x for *_, r, x in mine if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(mine), digest)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())


def test_chat_query_reads_the_probe(spark, tmp_path):
    spark.createDataFrame([(0, 0, "user", "a")], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    rows = {r.conv_id: r for r in chat_format.op8_chat_format(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7].turns_sha256 == sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (rows[-7].loss_chars, rows[-7].loss_sha256) == (len(said), sha256(said.encode()).hexdigest())
    assert (rows[0].n_turns, rows[0].loss_chars) == (1, 0)


URLS = [
    ("https://a.example.org/es/x", "example.org/es/", "block"), ("http://EXAMPLE.org/en/12?q", "example.org/en/1", "block"),
    ("http://example.org/en/2#f", "org/", "allow"), ("http://x.com/fr/", "com/fr/", "allow"), ("x://com/de/a", "com/de/", "block"),
    ("http://xcom/de/a", None, "allow"), ("http://example.org?x/es/", None, "allow"), ("example.org/es/", None, "allow"),
    (None, None, "allow"), ("", None, "allow"), ("http://notexample.org/es/", "org/", "allow"), ("http://a.com/es/", None, "allow"),
]


def test_urls(frame, spark):
    pages = frame([(i, u) for i, (u, *_) in enumerate(URLS)] * 2, "page_id long, url string")
    rules = spark.createDataFrame([*url_filter.RULES, ("org", "/", None)], "host string, path string, verdict string")
    got = values(url_filter.filter_urls(pages, rules), "page_id", "rule", "verdict")
    assert got == sorted([(i, r, v) for i, (_, r, v) in enumerate(URLS)] * 2, key=repr)
    none = url_filter.filter_urls(pages, rules.limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_trie_is_the_longest_fitting_rule():
    rng = np.random.default_rng(8)
    hosts, paths = ["", "a", "b.a", "c.b.a"], ["", "/", "/x", "/x/", "/x/y", "/xy"]
    for _ in range(40):
        rules = [(hosts[rng.integers(4)].encode(), paths[rng.integers(6)].encode(), "block") for _ in range(5)]
        trie = url_filter.Trie(rules)
        for host in (b"a", b"b.a", b"z.c.b.a", b"b"):
            for path in (b"", b"/", b"/x/y/z", b"/xyz"):
                fits = [
                    (len(h + p), len(h), h + p) for h, p, _ in rules
                    if (not h or host == h or host.endswith(b"." + h)) and path.startswith(p)
                ]
                got = trie.match(host, path)
                assert (got and got[0]) == (max(fits)[2] if fits else None)


def test_block_holds_over_allow():
    trie = url_filter.Trie([(b"a", b"/", "allow"), (b"a", b"/", "block")])
    assert trie.match(b"a", b"/x") == (b"a/", "block")


TONGUES = {"aa": "kato mina loru sepi", "bb": "strong thrift whelm chord", "cc": "äöü ßeöl üüfä ölöß"}


def plain_language(rows, text):
    """Nearest of texts (one to a language, so each is its centroid), with plain n-grams and dicts."""

    def grams(t):
        body = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + t.lower().encode() + b" ")
        said = Counter()
        for n in (1, 2, 3):
            for i in range(len(body) - n + 1):
                h = [int(b) for b in body[i : i + n]]
                if n == 1:
                    said[h[0]] += 1
                else:
                    v = (h[0] * 0x9E3779B1 + h[1] * 0x85EBCA6B) % 2**32
                    if n == 3:
                        v = (v * 0xC2B2AE35 + h[2] * 0x27D4EB2F) % 2**32
                    said[v >> 19] += 1
        return said

    every = [grams(t) for _, t in rows]
    idf = {b: math.log((1 + len(rows)) / (1 + sum(b in g for g in every))) + 1 for b in range(language_id.BUCKETS)}

    def vector(said):
        v = {b: math.log1p(n) * idf[b] for b, n in said.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()}

    mine = vector(grams(text))
    cosines = [sum(x * v.get(b, 0) for b, x in mine.items()) for v in map(vector, every)]
    best = max(range(len(rows)), key=lambda i: cosines[i])
    return rows[best][0], cosines[best]


def test_language_against_plain_counts(frame, prose):
    rows = [(f"l{i}", prose(40, i).replace("a", "aáàâ"[i % 4]).replace("o", "oöôó"[i % 4])) for i in range(6)]
    docs = frame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    model = language_id.train(docs)
    for seed in range(20, 32):
        text = prose(15, seed).replace("a", "aáàâ"[seed % 4])
        lang, cosine = plain_language(rows, text)
        got = model.predict(text)
        assert got[0] == lang and got[1] == pytest.approx(cosine, abs=1e-4)


def test_every_language_is_learned(frame):
    alphabet = [chr(0x4E00 + i) for i in range(3000)]
    langs = [f"x{i:03}" for i in range(260)]
    docs = [(8 * i + k, lang, " ".join(alphabet[11 * i + (j * (k + 3)) % 11] * 2 for j in range(30))) for i, lang in enumerate(langs) for k in range(3)]
    docs += [(None, "x000", None), (None, None, "text"), (9_999, "mute", "123 ...")]
    table = frame(docs, "doc_id long, lang string, text string")
    model = language_id.train(table)
    assert model.languages == langs
    got = {r.doc_id: r.lang_pred for r in language_id.identify(table.filter("doc_id IS NOT NULL"), model).collect()}
    assert got == {d: "und" if lang == "mute" else lang for d, lang, _ in docs if d is not None}


def test_language(frame):
    rng = np.random.default_rng(1)
    rows = [(i, k, " ".join(rng.choice(v.split(), 30))) for i, (k, v) in enumerate(list(TONGUES.items()) * 30)]
    rows += [(200, None, "kato"), (201, "aa", None), (202, "aa", "12 !?"), (203, None, "Strong thrift"), (203, None, "Strong thrift"), (204, None, "жщц " * 50)]
    docs = frame(rows, "doc_id long, lang string, text string")
    model = language_id.train(language_id.learning_rows(docs))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected for i, k, _ in rows[:90])
    assert (got[200].lang_pred, got[203].lang_pred) == ("aa", "bb") and not got[203].rejected
    assert [got[i].lang_pred for i in (201, 202)] == ["und", "und"] and got[201].rejected and got[204].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    nothing = language_id.train(docs.filter("false"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_long_texts_count_as_short_ones_do(monkeypatch):
    text = "some words of a text " * 40
    whole = language_id.counts_of(text)
    monkeypatch.setattr(language_id, "_SPAN", 17)
    assert (language_id.counts_of(text) == whole).all()


def test_one_conversation_is_hashed_turn_by_turn(spark, tmp_path, monkeypatch):
    def never(*a):
        raise AssertionError("a conversation was held whole")

    monkeypatch.setattr(chat_format, "format_chats", never)
    turns = [(None, i, ["user", "assistant", "narrator"][i % 3], f"say {i} </s>") for i in range(25_000)]
    given = spark.createDataFrame([*turns, (0, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    given.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    made = {r.conv_id: r for r in chat_format.op8_chat_format(spark, str(tmp_path)).collect()}
    assert set(made) == {None, 0, -7}
    whole = sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
    loss = "".join(t for _, _, r, t in turns if r == "assistant")
    _, _, written = chat_format.assemble(encoder(default_path()), [t[2:] for t in turns])
    assert tuple(made[None]) == (None, 25_000, whole, len(loss), sha256(loss.encode()).hexdigest(), len(written))
