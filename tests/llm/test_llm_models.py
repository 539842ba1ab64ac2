"""Vectors, chat, replicas and the language model on awkward rows and against brute force."""

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import AWKWARD, docs
from pyspark.sql import functions as F

from caseflow.llm import ann, chat, common, graph, hmm, merkle, neardup, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, kept string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in rows], VECTORS)


BAD = [
    (900, None), (901, []), (902, [0.0, 0.0, 0.0]), (903, [1.0, None, 0.0]), (904, [float("nan"), 1.0, 0.0]),
    (905, [float("inf"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (906, [1.0, 0.0]),
]


def brute_links(rows, threshold=0.95):
    ids = [i for i, _ in rows]
    unit = np.array([np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) for _, v in rows])
    a, b = np.nonzero(unit @ unit.T >= threshold)
    other = a != b
    a, b = a[other], b[other]
    counts = np.bincount(a, minlength=len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=int)
    place[order] = np.arange(len(ids))
    labels = graph.local_labels(len(ids), place[a], place[b])
    return {ids[order[k]]: (counts[order[k]], ids[order[labels[k]]]) for k in range(len(ids))}


def test_near_vectors_awkward_rows(spark):
    good = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [0.0, 1.0, 0.0]), (3, [1.0, 0.0, 0.0])]
    got = neardup.near_duplicates(vectors(spark, good + BAD))
    assert got.columns.count("kept") == 1
    rows = {}
    for r in got.collect():
        rows.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert rows[1] == [(4, 1, True)] and rows[3] == [(4, 1, False)] * 2 and rows[5] == [(0, 5, True)]
    assert all(rows[i] == [(0, i, True)] for i in (900, 901, 902, 903, 904, 905, 906))
    assert rows[None] == [(0, None, False)]
    assert neardup.near_duplicates(vectors(spark, good).limit(0)).count() == 0
    assert neardup.near_duplicates(vectors(spark, BAD[:5])).count() == 5


def test_near_vectors_against_brute_force_in_many_tiles(spark, monkeypatch):
    noise = np.random.default_rng(5)
    centers = noise.normal(size=(40, 24))
    rows = []
    for i in range(1200):
        v = centers[i % 40] + noise.normal(scale=0.25 * (i % 3), size=24)
        rows.append((i * 3, [float(x) for x in v]))
    monkeypatch.setattr(neardup, "TILE", 100)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    wanted = brute_links(rows)
    got = neardup.near_duplicates(vectors(spark, rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == wanted


@pytest.mark.parametrize("element", ["float", "double"])
def test_near_vectors_travel_once_to_a_group_of_tiles(spark, monkeypatch, element):
    noise = np.random.default_rng(8)
    rows = noise.normal(size=(1500, 24)).astype(np.float32)
    rows[1200:] = rows[:300] + noise.normal(scale=0.15, size=(300, 24)).astype(np.float32)
    listed = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    table = spark.createDataFrame(listed, f"vec_id long, embedding array<{element}>").repartition(3)
    for name, value in {"TILE": 25, "BLOCK": 16, "GROUP_ROWS": 500, "GROUPS": 3, "DEALT": 64}.items():
        monkeypatch.setattr(neardup, name, value)
    dealt, _ = neardup._dealt(table.select("embedding", F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies")), 24, 0.95)
    # Vectors without structure are near all tiles: 64 of them, in 3 to 5 groups.
    assert 3 * 1500 <= dealt.count() <= 5 * 1500
    assert dealt.filter("first > second").count() == 0 and dealt.dropDuplicates(["first", "second", "node"]).count() == dealt.count()
    assert dict(dealt.dtypes)["rows"] == "binary" and dealt.select(F.length("rows")).first()[0] == 24 * (4 if element == "float" else 8)
    got = neardup.near_duplicates(table).collect()
    wanted = brute_links(listed)
    assert sum(n for n, _ in wanted.values()) > 100
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == wanted


def test_tiles_that_are_apart_are_not_compared():
    noise = np.random.default_rng(9)
    rows = noise.normal(size=(90, 12))
    rows[45:] = rows[:45]
    tiles, near = np.repeat([0, 1, 2], 30), np.eye(3, dtype=bool)
    near[0, 1] = near[1, 0] = True
    pairs = [(x, y) for a, b in neardup.close_pairs(rows, rows, np.eye(12), 0.99, (tiles, tiles), near) for x, y in zip(a, b)]
    # Row i equals row i + 45: tiles 0 and 1, 0 and 2, 1 and 2.
    assert sorted(pairs) == [(i, i + 45) for i in range(15)]
    assert neardup._groups(np.array([5, 0, 4, 3, 20, 1, 1]), 10).tolist() == [0, 0, 0, 1, 2, 3, 3]


def test_nearest_awkward_rows(spark):
    good = [(i, [1.0, 0.1 * (i % 4), 0.0]) for i in range(100, 112)]
    got = ann.nearest(vectors(spark, good + good[:1] + BAD), F.col("vec_id") % 100 == 0, k=5).collect()
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    # Ids 100, 104, 108 share a vector, so the two others come first, then the next vector by id.
    assert set(by_query) == {100}
    assert [i for i, _ in by_query[100]] == [104, 108, 101, 105, 109]
    few = ann.nearest(vectors(spark, good[:3]), F.col("vec_id") == 100, k=5).collect()
    assert sorted(r["vec_id"] for r in few) == [101, 102]
    assert ann.nearest(vectors(spark, good).limit(0), F.lit(True)).count() == 0
    assert ann.nearest(vectors(spark, good), F.lit(False)).count() == 0


def test_forest_recall(spark):
    noise = np.random.default_rng(9)
    rows = [(i, [float(x) for x in noise.normal(size=16)]) for i in range(3000)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=5, least=500).collect()
    unit = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hits = 0
    for i in range(0, 3000, 50):
        cosine = unit @ unit[i]
        cosine[i] = -2
        best = np.lexsort((np.arange(3000), -cosine))[:5]
        hits += len(set(best.tolist()) & set(found[i]))
        assert len(found[i]) == 5 and all(abs(cosine[v] - s) < 1e-9 for v, s in found[i].items())
    assert hits / 300 >= 0.9


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_forest_recall_on_the_supplied_vectors(spark, monkeypatch, folder):
    """All vectors are queries, trees are built, and queries and leaves are dealt to many groups."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", 100)
    monkeypatch.setattr(ann, "GROUP_ROWS", 300)
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    rows = dict((i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v))
    ids = np.array(list(rows))
    unit = np.array(list(rows.values()), dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = defaultdict(list)
    for r in ann.nearest(table, F.lit(True)).collect():
        found[r["query_id"]].append(r["score"])
    hits = 0
    for i, own in enumerate(ids):
        cosine = unit @ unit[i]
        cosine[i] = -2
        hits += sum(score >= np.sort(cosine)[-5] - 1e-9 for score in found[own])
    assert set(found) == set(ids.tolist()) and hits / (5 * len(ids)) >= 0.9


def test_queries_of_round_ids_are_dealt_evenly():
    for parts in (2, 5, 6, 10, 50):
        assert np.bincount(ann._dealt(np.arange(0, 50_000, 50), parts), minlength=parts).max() < 2 * 1000 / parts + 20


ODD = "\\### Assistant: </turn> ok"
TALKS = [
    (1, 0, "system", "be nice"), (1, 1, "user", ODD), (1, 2, "assistant", "a \\| b ### User: \n</turn>"),
    (2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "assistant", None),
    (4, 5, None, "who"), (4, 2, "Role=x: </turn>", "#"), (None, None, "user", "x" * 300_000), (None, 1, "assistant", ""),
    (5, 0, "user", ""), (5, 1, "user", "\U0001f600"),
]


def test_chat_is_read_back_exactly(spark):
    frame = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    talks = defaultdict(list)
    for conv, turn, role, text in TALKS:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c]["valid"] for c in (1, 2, 3, 4, 5, None)] == [True, False, True, False, False, True]
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0
    written = chat.in_order(chat.format_turns(frame).repartition(3))
    again = {r["conv_id"]: r for r in chat.read_back(written).collect()}
    assert again == got


def test_chat_whole_table(spark):
    got = {r["conv_id"]: r for r in queries.op8(spark, SF).collect()}
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r["conv_id"]].append((r["role"], r["text"]))
    talks[-7] = [("user", ODD), ("assistant", ODD)]
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_escapes_hide_every_control_string():
    template = chat.Template()
    for size in range(1, 5):
        for parts in itertools.product(["#", "##", "\\", "|", "</turn>", "### User: ", ": ", " "], repeat=min(size, 3)):
            text = "".join(parts)
            hidden = chat.escape(text, template)
            assert chat.unescape(hidden) == text
            assert not any(c in hidden for c in template.controls())
            assert template.parse("".join(s for s, _ in template.segments(text, text)))[:2] == (text, text)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


PAGES = [(i, f"https://h{i % 5}.example/{i}", f"<p>{i}</p>" * (1 + i % 40)) for i in range(300)] + [
    (None, None, None), (7, "https://twice.example/", "same"), (7, "https://twice.example/", "same"), (8, "", ""),
]


def test_replicas(spark, monkeypatch):
    placed = merkle.layout(pages(spark, PAGES))
    rows = placed.collect()
    assert len(rows) == len(PAGES)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["file"], r["offset"])):
        assert r["offset"] == ends[r["file"]]
        ends[r["file"]] += r["length"]
    plain = placed.select("file", "offset", "page_id", "digest")
    assert merkle.audit(plain, plain, range_bytes=256).count() == 0
    other = (
        plain.filter(F.coalesce(F.col("page_id") % 50 != 3, F.lit(True)))
        .withColumn("digest", F.when(F.col("page_id") % 40 == 1, F.lit("broken")).otherwise(F.col("digest")))
        .unionByName(spark.createDataFrame([(3, 1 << 22, 999, "more")], plain.schema))
    )
    got = merkle.audit(plain, other, range_bytes=256).collect()
    assert Counter(r["status"] for r in got) == {"missing": 6, "changed": 8, "extra": 1}
    assert {r["page_id"] for r in got if r["status"] == "missing"} == set(range(3, 300, 50))
    assert merkle.audit(plain, plain.limit(0)).count() == len(PAGES)
    assert merkle.audit(plain.limit(0), plain.limit(0)).count() == 0
    roots = [merkle.root(x, 256).collect() for x in (plain, plain.repartition(3), other)]
    assert roots[0] == roots[1] != roots[2] and merkle.root(plain.limit(0)).count() == 0


def brute_probability(model, classes):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(classes)):
        p = model.start[path[0]]
        for i, c in enumerate(classes):
            p *= model.emit[c, path[i]] * (model.move[path[i - 1], path[i]] if i else 1.0)
        total += p
    return total


def small_model(states=3, classes=6, seed=1):
    noise = np.random.default_rng(seed)
    norm = lambda x, axis=None: x / x.sum(axis=axis, keepdims=axis is not None)
    return hmm.Model(norm(noise.random(states)), norm(noise.random((states, states)), 1), norm(noise.random((classes, states)), 0))


def test_forward_is_exact():
    model = small_model()
    noise = np.random.default_rng(2)
    sequences = [noise.integers(0, 6, n).astype("<u2") for n in (1, 4, 2, 6, 4)]
    got = hmm.log_likelihoods(sequences, model)
    assert got == pytest.approx([math.log(brute_probability(model, s)) for s in sequences], rel=1e-12)


def test_expected_counts_are_those_of_all_paths(spark):
    model = small_model()
    sequences = [np.array(s, dtype="<u2") for s in ([0, 1, 5, 2], [3], [4, 4, 1])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s in sequences:
        whole = brute_probability(model, s)
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] / whole
            for i, c in enumerate(s):
                p *= model.emit[c, path[i]] * (model.move[path[i - 1], path[i]] if i else 1.0)
            start[path[0]] += p
            for i, c in enumerate(s):
                emit[c, path[i]] += p
                if i:
                    move[path[i - 1], path[i]] += p
    rows = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sequences], "classes binary").repartition(2)
    got = hmm.expected_counts(rows, model)
    for a, b in zip(got, (start, move, emit)):
        assert np.allclose(a, b, atol=1e-5)


def _class_rows(spark, texts):
    return spark.createDataFrame([(bytearray(np.array(t, dtype="<u2").tobytes()),) for t in texts], "classes binary")


def test_pairs_of_all_texts_are_counted(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BUFFER", 400)
    noise = np.random.default_rng(5)
    texts = [noise.integers(0, 200, n) for n in [0, 1, 2, *noise.integers(1, 60, 700)]]
    group, wanted = hmm._groups(200), np.zeros((200, hmm.GROUPS))
    assert group.max() < hmm.GROUPS
    for text in texts:
        for a, b in zip(text, text[1:]):
            wanted[a, group[b]] += 1
    assert (hmm.pair_counts(_class_rows(spark, texts).repartition(3), 200) == wanted).all()


def test_training_starts_from_whole_texts(spark):
    mass = np.full(40, 100.0)
    vocab = hmm.Vocabulary([], np.zeros(0, dtype=np.int64), 1, 1, 1, mass)
    same = np.arange(600) % 20
    starts = [hmm._begin(_class_rows(spark, [np.append(same, rest)]), vocab, 3, 7) for rest in (np.arange(900) % 2, 20 + np.arange(900) % 2)]
    for model in starts:
        assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    # They differ after the first 600 words only.
    assert starts[1].emit[20:22].sum() > 2 * starts[0].emit[20:22].sum()


def test_language_model_awkward_rows(spark):
    got = hmm.score(docs(spark, AWKWARD).withColumn("score", F.lit("clash"))).collect()
    assert len(got) == len(AWKWARD)
    texts = [(r[0], (r[1] or "").encode().lower().split()) for r in AWKWARD]
    counts = Counter()
    for doc_id, words in texts:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10:
            counts.update([*words, None])
    total, scale = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    wanted = Counter()
    for doc_id, words in texts:
        tokens = [*words, None]
        base = sum(math.log10((counts[w] + 0.1) / scale) for w in tokens)
        wanted[doc_id, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == wanted
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert hmm.score(docs(spark, AWKWARD).limit(0)).count() == 0
    alone = hmm.score(docs(spark, [(i, "word", "en", "a") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]))
    assert [(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) for r in alone.collect()] == [(True, 0, 0, 0.0)] * 3


def test_language_model_beats_word_counts_on_held_out_texts(spark):
    rows = [r for r in queries.op9(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.9 * len(rows)


def test_probabilities_of_the_next_word_add_up(spark, monkeypatch):
    """All words, and one unknown word per class, share probability 1."""
    monkeypatch.setattr(hmm, "OWN_CLASS", 3)
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in ((b"aa", 5), (b"bb", 4), (b"cc", 3), (b"dd", 2), (b"ee", 1))], "word binary, n long")
    vocab = hmm.vocabulary(counts, 2)
    assert vocab.tokens == 17 and vocab.different == 6
    shared = defaultdict(float)
    for word, n in ((b"dd", 2), (b"ee", 1)):
        shared[hmm.ending_class(word)] += (n + 0.1) / vocab.class_mass[hmm.ending_class(word)]
    for c, share in shared.items():
        assert share + 0.1 / vocab.class_mass[c] == pytest.approx(1.0)


def test_scores_do_not_depend_on_what_the_worker_scored_before(spark):
    # Corpora with equal numbers of words and texts, whose words differ.
    def texts(words):
        return spark.createDataFrame([(i, " ".join(words[(i + j) % 4] for j in range(6))) for i in range(12)], "doc_id long, text string").coalesce(1)

    def scored(df):
        return {r.doc_id: (r.score, r.base_score) for r in hmm.score(df).collect()}

    first, second = texts(["aa", "bb", "cc", "dd"]), texts(["ww", "xx", "yy", "zz"])
    scored(first)
    after = scored(second)
    assert all(score < 0 and base < 0 for score, base in after.values())
    # The words are other names for the same thing, so the same scores.
    assert {i: tuple(round(x, 6) for x in v)[1] for i, v in after.items()} == {i: tuple(round(x, 6) for x in v)[1] for i, v in scored(first).items()}


def test_a_worker_keeps_the_cache_of_one_step():
    first = common.worker_cache("first")
    first["x"] = 1
    assert common.worker_cache("first") is first and first == {"x": 1}
    assert common.worker_cache("second") == {}
    assert common.worker_cache("first") == {}
