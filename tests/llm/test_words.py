"""Spelling variants, periodic runs and byte-level BPE against plain versions, and their defined edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanlode.llm import byte_bpe, periodic_runs, spelling

CLASHING = ("word", "n", "row", "k", "next", "at", "short", "best", "group", "part", "ids", "head", "tail", "start", "d", "r", "h")
RANKS = byte_bpe.ranks_path()


def frame(spark, rows):
    """(doc_id, text) rows with extra columns whose names clash."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def odd_rows():
    long = " ".join(f"word{i % 500} the of" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, long), (5, "one two"), (6, "one two"), (6, "one two"), (None, "no id here"), (None, None), (8, "Ünïcode ß \U0001f600 ́x a\x1cb\x85c"), (9, "." * 50_000), (10, "x" * 40_000 + " y")]


# 11: spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(rows):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    others = {w: sorted((-n[o], o) for o in n if o != w and abs(len(o) - len(w)) <= 1 and near(w, o)) for w in n}
    form = {w: o[0][1] if o and -o[0][0] >= 5 * n[w] else None for w, o in others.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(others[w]), n[form[w]] if form[w] else -1) for w in n)


def told(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_are_those_of_all_pairs(spark):
    rnd = random.Random(11)
    roots = ["bananas", "vanilla", "größere", "aaaaaaa", "letters"]
    words = []
    for root in roots:
        for _ in range(40):
            w = root
            for _ in range(rnd.randint(0, 3)):
                i = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:i] + rnd.choice("abé÷z") + w[i:], w[:i] + w[i + 1 :], w[: i - 1] + rnd.choice("abe") + w[i:] if i else w])
            words += [w] * rnd.choice([1, 5, 5, 6, 30, 31, 160, 900])
    rnd.shuffle(words)
    rows = [(i, " ".join(words[i::60]).replace("bana", "BaNa")) for i in range(60)] + [(None, "bananas " * 7), (3, None), (4, "")]
    want = plain_variants(rows)
    assert told(spelling.variants(frame(spark, rows))) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 5 for w in want)


def test_ties_go_to_the_first_word(spark):
    words = spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdeh", 25), ("abcdeé", 25), ("abcdefx", 24)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling.forms(words).collect()}
    assert got["abcdef"] == (4, "abcdeg", 25) and got["abcdefx"] == (1, None, None) and got["abcdeé"] == (3, None, None)


def test_long_words_are_opened_only_where_half_of_them_recurs(spark):
    w = "abcdefghij" * 20
    words = [(w, 5), (w + "q", 30), ("x" + w, 5), (w[:99] + "Z" + w[100:], 7), ("k" * 5000, 9), ("lonely" * 4000, 5)]
    df = spark.createDataFrame(words, "word string, n long")
    assert {len(r["word"]) for r in spelling.comparable(df).collect()} <= {200, 201}
    want = {x: sum(near(x, y) for y, _ in words if y != x) for x, _ in words}
    assert {r["word"]: r["n_near"] for r in spelling.forms(df).collect()} == want


def test_variants_of_odd_texts_and_of_nothing(spark, odd_rows):
    rows = odd_rows * 5
    assert told(spelling.variants(frame(spark, rows))) == plain_variants(rows)
    assert spelling.variants(frame(spark, []).limit(0)).count() == 0


# 12: periodic runs


def plain_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    runs = sorted((s, k, q) for (s, k), q in found.items())
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {x for s, k, q in runs for x in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *told, hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def reported(rows):
    return [tuple(r.values()) for r in periodic_runs.report([d for d, _ in rows], pa.array([t for _, t in rows], pa.string())).to_pylist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(1, 9)), max_size=6)), max_size=6))
def test_runs_are_those_of_every_period(docs):
    rows = [(d, " ".join(x for part, times in parts for x in part * times)) for d, parts in docs]
    assert reported(rows) == [plain_runs(*r) for r in rows]


def test_runs_of_odd_texts(spark, odd_rows):
    rows = [(d, t) for d, t in odd_rows if len(t or "") < 200_000] + [(36, "a b a b c " * 90), (36, "tail"), (7, "x " * 500 + "y " * 500), (11, "a b c " * 4), (12, "a a a a a"), (13, "a a a a a a")]
    got = periodic_runs.periodic_runs(frame(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_runs(*r) for r in rows), key=repr)
    assert periodic_runs.periodic_runs(frame(spark, []).limit(0)).count() == 0


def test_long_texts_take_no_quadratic_time():
    for text in ("a " * 300_000, "a b " * 150_000, " ".join(str(i % 700) for i in range(300_000))):
        period = len(set(text.split()))
        assert reported([(1, text)])[0][1:5] == (1, 0, 300_000, period)


def test_suffixes_of_each_text_are_sorted_apart():
    words, starts = np.array([1, 0, 1, 0, 1, 0, 1]), np.array([0, 3, 7])
    text, end = np.array([0, 0, 0, 1, 1, 1, 1]), np.array([3, 3, 3, 7, 7, 7, 7])
    suffixes = [(text[i], tuple(words[i : end[i]])) for i in range(7)]
    rank = periodic_runs.suffix_ranks(words, text, end)
    assert [sorted(suffixes).index(s) for s in suffixes] == rank.tolist()
    order = np.argsort(rank)
    want = [0]
    for a, b in zip(order, order[1:], strict=False):
        same = [x == y for x, y in zip(words[a : end[a]], words[b : end[b]], strict=False)] if end[a] == end[b] else []
        want.append((same + [False]).index(False))
    assert periodic_runs.lcp_array(words, rank, end).tolist() == want
    assert periodic_runs.next_smaller(rank, end).tolist() == [next((j for j in range(i + 1, end[i]) if rank[j] < rank[i]), end[i]) for i in range(7)]
    assert len(periodic_runs.runs_of(words, starts)[0]) == 0


# 13: byte-level BPE


def plain_bpe(doc_id, text):
    ids = byte_bpe.whole_encoder(RANKS).encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_whole_texts_are_encoded_as_by_the_library(spark, odd_rows):
    rnd = random.Random(13)
    size, over = byte_bpe.CHUNK, byte_bpe.OVERLAP
    mixed = "".join(rnd.choice("a b'sreé \U00013430 ՘ 1,٣꟏\n\t中") for _ in range(90_000))
    rows = [*odd_rows, (20, "a" * 60_000 + "b c " * 9_000), (21, "x" + "\n" * 40_000 + " y"), (22, "'re" * 20_000), (23, mixed), (24, ("a" * 20_000 + " ") * 5 + "bbb")]
    rows += [(30 + k, ("hello world. " * 3_000)[: size + over + k]) for k in (-1, 0, 1, size - 1, size, size + 1)] + [(40, "中" * 40_000 + "。" + "文" * 20_000)]
    got = byte_bpe.round_trip(frame(spark, rows).repartition(4), RANKS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_bpe(*r) for r in rows), key=repr)


def test_white_space_beyond_the_library_pattern_round_trips(spark):
    text = "begin" + " " * 1_200_000 + "end"
    ids = byte_bpe.encode_apart(RANKS, text)
    (row,) = byte_bpe.round_trip(frame(spark, [(1, text)]), RANKS).collect()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pieces_and_bytes_of_a_row_are_in_order(spark):
    rows = [(1, "one two " * 9_000), (1, "one two " * 9_000), (None, "short"), (2, None)]
    encoded = byte_bpe.encode(frame(spark, rows), RANKS)
    texts, parts = {}, Counter()
    for r in sorted(byte_bpe.decode(encoded, RANKS).collect(), key=lambda r: (r["row"], r["part"])):
        texts[r["row"]] = texts.get(r["row"], b"") + bytes(r["bytes"])
        parts[r["row"]] += 1
    assert sorted(texts.values()) == sorted((t or "").encode() for _, t in rows) and sorted(parts.values())[-2:] == [5, 5]


def test_characters_that_tables_class_differently_split_as_in_the_library():
    odd = [chr(c) for c in byte_bpe._stand_ins()][:4_000]
    text = " ".join(f"a{c}1{c}. {c}" for c in odd)
    assert byte_bpe.encode_apart(RANKS, text) == byte_bpe.whole_encoder(RANKS).encode_ordinary(text)


def test_chunks_resynchronise_or_are_joined(spark):
    rows = [(1, "word " * 20_000), (2, "y" * 50_000 + " word" * 9_000)]
    chunks = byte_bpe.marked(byte_bpe.slices(frame(spark, rows)))
    places = {(r["row"], r["k"]): r["at"] for r in byte_bpe.synchronised(chunks).collect()}
    loose = [k for k, at in places.items() if at is None]
    assert len({r for r, _ in places}) == 2 and len({r for r, _ in loose}) == 1 and loose
    fixed = byte_bpe.joined(chunks, byte_bpe.synchronised(chunks))
    for _, text in rows:
        assert any(r["text"].startswith(text[: byte_bpe.CHUNK]) for r in fixed.collect())


def test_bpe_of_nothing(spark):
    empty = frame(spark, []).limit(0)
    assert byte_bpe.round_trip(empty, RANKS).count() == 0 and byte_bpe.encode(empty, RANKS).count() == 0


# 5: repeated ids


def test_rows_that_repeat_an_id_are_one_vertex(spark):
    from scanlode.llm import embedding_dedup

    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 0), (5, a, 0), (2, b, 0), (5, b, 0), (5, b, 0), (7, c, 0), (7, c, 0), (9, b, 1), (5, c, 1), (8, c, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (1, 1, True), 5: (3, 1, False), 2: (1, 1, False), 7: (0, 7, True), 9: (0, 9, True), 8: (1, 1, False)}


# 4: headings over comments


@pytest.mark.parametrize(
    "page, kept, lost",
    [
        ("<article><h2>Responses</h2>{0}{1}</article>", "Responses|0|1", ""),
        ("<article><h1>Comments</h1>{0}</article>", "Comments|0", ""),
        ("<article><h1>T</h1>{0}<h2>Response</h2>{1}</article>", "0|Response|1", ""),
        ("<article><h1>T</h1>{0}<h2>Comments</h2>{1}{2}</article>", "0|Comments|1|2", ""),
        ("<div><h1>T</h1>{0}</div><div><h3>2 Comments</h3>{1}{2}</div>", "0", "2 Comments|1|2"),
        ("<div><h1>T</h1>{0}<h3>Comments</h3><p>Ann said:</p>{1}<p>Bob, 3 days ago</p>{2}</div>", "0", "Comments|Ann said|1|Bob|2"),
        ("<div><h1>T</h1>{0}<section><h3>Replies (2)</h3>{1}</section>{2}</div>", "0|2", "Replies|1"),
    ],
)
def test_a_heading_over_comments_needs_evidence(page, kept, lost):
    from scanlode.llm import html_text

    texts = [f"This is paragraph {k} of an article about the weather and the way that it has changed in the last ten years for all of us, and what we can do." for k in range(3)]
    got = html_text.main_text(page.format(*(f"<p>{t}</p>" for t in texts)))
    full = lambda x: texts[int(x)] if x.isdigit() else x
    assert all(full(x) in got.split("\n") for x in kept.split("|") if x) and not any(full(x) in got for x in lost.split("|") if x)


def test_a_short_end_stays_with_its_paragraph():
    from scanlode.llm import html_text

    first = "The end of the day is when we all go home and rest for a while, and then we come back to the place where we were before it all began."
    assert html_text.main_text(f"<div><p>{first}</p><p>Short end.</p></div><ul><li><a href=x>More</a></li></ul>") == f"{first}\nShort end."


# 10: whole licenses


def test_whole_licenses_are_found_in_long_texts(spark):
    from scanlode.llm import licenses

    texts = licenses.whole_texts()
    licenses.check_templates(licenses.all_templates())
    assert len(texts) >= 13 and min(map(len, map(licenses.template_words, texts.values()))) > licenses.LONG
    rnd = random.Random(10)
    fill = " ".join(f"word{rnd.randrange(3000)} of the program" for _ in range(4000))
    cut = lambda t, share: t[: int(len(t) * share)]
    rows, want = [], {}
    for i, (name, text) in enumerate(texts.items()):
        rows += [(10 * i, text), (10 * i + 1, fill[: 997 * (i + 1)] + " " + text.upper() + " " + fill), (10 * i + 2, cut(text, 0.5))]
        want[10 * i] = want[10 * i + 1] = name
    rows += [(900, fill), (901, texts["GPL-3-text"] * 2)]
    docs = frame(spark, rows)
    got = {}
    for r in licenses.scan(docs).where(F.col("template").endswith("-text")).collect():
        got.setdefault(r["doc_id"], {})[r["template"]] = r["containment"]
    assert all(got[i][name] == 1.0 for i, name in want.items()) and got[901]["GPL-3-text"] == 1.0 and 900 not in got
    assert not any(i % 10 == 2 for i in got if i < 900)
