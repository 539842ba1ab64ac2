"""Block rotation, FM-index and collocations against plain loops over small tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import AWKWARD, docs

from caseflow.llm import collocations, fim, fmindex
from caseflow.llm.common import stored

# ---------------------------------------------------------------- fill in the middle


def _expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [(100 + i, t, None, None) for i, t in enumerate(["<P>", "a <M> b", "<", "<<S", "x<P", "P><S", "é", "漢\U0001f600", "a-b", "<M"] * 6)]


def test_fill_in_the_middle_matches_plain_python(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, form string, output string, restored string"
    table = docs(spark, AWKWARD + ODD, schema)
    made = fim.restore(fim.transform(table))
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    rows = made.collect()
    assert len(rows) == len(AWKWARD) + len(ODD)
    for row in rows:
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == _expected(row.doc_id, row.text)
        assert row.restored == (row.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(table.limit(0))).collect() == []


@pytest.mark.parametrize("size", [0, 1, 2, 5, 300])
def test_rotation_in_place(monkeypatch, size):
    monkeypatch.setattr(fim, "SWAP", 7)
    data = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
    for middle in {0, size // 3, size}:
        buffer = bytearray(b"<" + data + b">")
        fim.rotate(buffer, 1, 1 + middle, 1 + size)
        assert buffer == b"<" + data[middle:] + data[:middle] + b">"
        fim.rotate(buffer, 1, 1 + size - middle, 1 + size)
        assert buffer == b"<" + data + b">"


# ---------------------------------------------------------------- FM-index

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _brute(rows, items, window=10):
    out = []
    for doc_id, text in rows:
        words, hit, found = _words(text), set(), set()
        for item_id, item in items:
            w = _words(item)
            size = min(len(w), window)
            runs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(words) - size + 1 if runs else 0):
                if tuple(words[i : i + size]) in runs:
                    hit |= set(range(i, i + size))
                    found |= {str(item_id)} if item_id is not None else set()
        out.append((None if doc_id is None else str(doc_id), len(words), tuple(sorted(hit)), tuple(sorted(found))))
    return Counter(out)


def _found(df):
    return Counter(
        (r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.start, s.stop)), tuple(sorted(r["items"])))
        for r in df.collect()
    )


ITEMS = "item_id long, text string, phrase string, w string"


def _items(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ITEMS)


def _corpus(seed=3):
    """Texts of few different words, so that phrases occur, overlap and touch."""
    pick = random.Random(seed)
    word = lambda: pick.choice(["Ab", "cd", "ef9", "g", "hé", "漢"])
    items = [(i, " ".join(word() for _ in range(pick.choice([1, 4, 9, 10, 11, 25])))) for i in range(12)]
    items += [(3, items[3][1]), (None, items[5][1]), (20, None), (21, " .!"), (22, items[7][1].upper())]
    rows = [(i, pick.choice([" ", "--", "\n"]).join(word() for _ in range(pick.choice([0, 1, 5, 30, 200])))) for i in range(40)]
    rows += [(i, f"x {items[i % 12][1]} y {items[(i + 1) % 12][1]}") for i in range(12)]
    rows += [(500, rows[3][1]), (None, rows[3][1]), (500, rows[3][1])] + [(600 + i, rows[-1][1]) for i in range(20)]
    return rows + [(r[0], r[1]) for r in AWKWARD], items


@pytest.mark.parametrize(("shard", "segment", "block"), [(1 << 20, 512, 1 << 25), (40, 16, 200)])
def test_fm_index_matches_a_plain_search(spark, monkeypatch, shard, segment, block):
    monkeypatch.setattr(fmindex, "SEGMENT_WORDS", segment)
    monkeypatch.setattr(fmindex, "_CHUNK", 64 if shard == 40 else 1 << 20)
    rows, items = _corpus()
    if shard == 40:
        rows = [r for r in rows if not r[1] or len(r[1]) < 10_000]  # a million words make many shards of 40
    table = docs(spark, rows)
    index = stored(fmindex.build(table, 10, shard), "test-index")
    assert index.count() > (20 if shard == 40 else 0)
    found = fmindex.search(index, fmindex.windows(_items(spark, items)), block_bytes=block)
    assert _found(found) == _brute(rows, items)


def test_fm_index_without_rows_or_phrases(spark):
    rows, items = _corpus()
    table = docs(spark, rows)
    none = fmindex.contamination(table, _items(spark, items).limit(0))
    assert all(not r.spans and not r["items"] for r in none.collect()) and none.count() == len(rows)
    assert fmindex.contamination(table.limit(0), _items(spark, items)).collect() == []


def test_suffix_order_and_rows_of_an_index():
    pick = np.random.default_rng(1)
    for size, top in ((1, 2), (40, 3), (300, 2), (300, 300)):
        symbols = np.append(pick.integers(0, top, size), 0).astype(np.int32)
        ends = {int(p): i for i, p in enumerate(np.flatnonzero(symbols == 0))}
        key = lambda i: [(0, ends[j]) if j in ends else (1, int(symbols[j])) for j in range(i, len(symbols))]  # noqa: B023, E731
        order = fmindex.suffix_order(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=key)
        place = np.arange(len(symbols)) - np.maximum.accumulate(np.where(np.append(True, symbols[:-1] == 0), np.arange(len(symbols)), 0))
        index = fmindex.FmIndex(len(symbols), *fmindex.FmIndex.parts(symbols, place % 4 == 0))
        words = np.flatnonzero(symbols[order] != 0)
        assert index.locate(words).tolist() == order[words].tolist()
        for phrase in itertools.product(range(1, min(int(symbols.max()) + 1, 4)), repeat=2):
            left, low, high = index.search(np.array([phrase]))
            own = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(left) else []
            assert own == [i for i in range(len(symbols) - 1) if tuple(symbols[i : i + 2]) == phrase]


def test_removed_spans(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    body = "One, two three-four five six seven eight\nnine ten ELEVEN"
    rows = [(1, f"Keep <b>{body}</b> this."), (1, f"Keep <b>{body}</b> this."), (2, "nothing here"), (3, None), (4, ""), (None, body)]
    table = docs(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, spans string, row string")
    found = fmindex.contamination(table, _items(spark, items))
    left = fmindex.removed(table, found)
    assert left.columns == table.columns
    clean = Counter((r.doc_id, r.text, r.digest) for r in left.collect())
    assert clean == Counter([*[(1, "Keep <b></b> this.", "clash")] * 2, (2, "nothing here", "clash"), (3, None, "clash"), (4, "", "clash"), (None, "", "clash")])


# ---------------------------------------------------------------- collocations


def _counts(rows, longest=5):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def _collocations(rows, least, share=100, top=2000):
    counts, totals = _counts(rows)
    counts = {k: n for k, n in counts.items() if n >= least}
    out = []
    for lang in sorted(totals):
        own = {p: n for (g, _, p), n in counts.items() if g == lang}
        kept = []
        for phrase, a in own.items():
            words = phrase.split(" ")
            if len(words) < 2:
                continue
            if any(f" {phrase} " in f" {p} " and p != phrase and 100 * f >= share * a for p, f in own.items()):
                continue
            cuts = [(own[" ".join(words[:k])], own[" ".join(words[k:])]) for k in range(1, len(words))]
            score, k = min((1000 * a * totals[lang] // (x * y), k) for k, (x, y) in enumerate(cuts))
            kept.append((-score, -a, phrase.encode(), phrase, *cuts[k]))
        for rank, (score, a, _, phrase, x, y) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase, -a, x, y, totals[lang], -score))
    return out


def _talk(seed=5, texts=120):
    pick = random.Random(seed)
    words = ["New", "york", "the", "of", "city", "in", "été", "漢", "a", "b"]
    weights = [5, 5, 20, 10, 4, 8, 2, 2, 3, 1]
    made = []
    for i in range(texts):
        some = pick.choices(words, weights, k=pick.choice([0, 1, 3, 40]))
        text = "".join(w + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in some)
        made.append((text, pick.choice(["en", "en", "de", None])))
    return made + [("new york city of the new york", "en")] * 30 + [(r[1], r[2]) for r in AWKWARD]


SMALL = "lang string, text string, words string, n string, phrase string, score string"


def _speech(spark, rows):
    return spark.createDataFrame([(lang, text, *["x"] * 4) for text, lang in rows], SMALL)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("share", [100, 60])
def test_collocations_match_plain_counts(spark, monkeypatch, small, share):
    rows = _talk()
    if small:
        # Cuts inside pieces, many partitions, several blocks and rounds.
        for name, value in (("BLOCK_WORDS", 7), ("_CHUNK", 5), ("PARTITION_BYTES", 500), ("KNOWN_WORDS", 4), ("HELD", 3), ("PART_PHRASES", 2)):
            monkeypatch.setattr(collocations, name, value)
        rows = [r for r in rows if not r[0] or len(r[0]) < 10_000]
    got = collocations.collocations(_speech(spark, rows), least=8, share=share).collect()
    assert sorted(map(tuple, got)) == _collocations(rows, 8, share)


def test_frequent_runs_in_rounds_and_first_of_each_language(spark, monkeypatch):
    rows = _talk(6)
    counts, totals = _counts(rows)
    table = _speech(spark, rows)
    got = Counter({(r.lang, r["words"], r.phrase): r.n for r in collocations.frequent(table, 5, round_size=20).collect()})
    assert got == Counter({k: n for k, n in counts.items() if n >= 5} | {(g, 0, ""): n for g, n in totals.items() if n})
    best = collocations.collocations(table, least=5, top=3).collect()
    assert sorted(map(tuple, best)) == _collocations(rows, 5, top=3)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(_speech(spark, _talk()).limit(0)).collect() == []
    assert collocations.collocations(_speech(spark, [(None, None), ("", "en")])).collect() == []


def test_merged_summaries_keep_every_frequent_hash():
    pick = np.random.default_rng(2)
    for least in (5, 20):
        parts = [np.minimum(pick.zipf(1.3, 400), 5000).astype(np.uint64) for _ in range(30)]
        whole = Counter(np.concatenate(parts).tolist())
        summary = collocations.Summary(len(np.concatenate(parts)) // least + 1)
        for part in parts:
            own = collocations.Summary(summary.capacity)
            hashes, counts = np.unique(part, return_counts=True)
            own.merge([hashes], [counts])
            summary.merge([own.hashes], [own.counts])
            summary.lost += own.lost
        assert summary.lost < least and len(summary.hashes) <= summary.capacity
        assert {h for h, n in whole.items() if n >= least} <= set(summary.survivors(least).tolist())


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    # Hashes of few bits: nearly all runs share one.
    rows = _talk(7)
    block = next(collocations.blocks(iter([_batch(rows)]), 1 << 20))
    wanted = np.arange(4, dtype=np.uint64)
    got = {}
    collocations._count(block, wanted, np.ones(1024, dtype=bool), 2, 5, got)
    counts, _ = _counts(rows)
    assert Counter({(g, p.count(b" ") + 1, p.decode()): n for g, found in got.items() for p, n in found.items()}) == counts


def _batch(rows):
    import pyarrow as pa

    langs = ["und" if lang is None else lang for _, lang in rows]
    return pa.RecordBatch.from_arrays([pa.array(langs), pa.array([(t or "").encode() for t, _ in rows], pa.binary())], ["lang", "text"])
