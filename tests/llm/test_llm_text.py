"""Packing, language, SimHash, mixing, secrets and the pipeline on awkward rows and against brute force."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_cases import AWKWARD, LONG_TEXT, docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseflow.llm import graph, langid, mixing, neardup, packing, queries, secrets, simhash

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def reference_ids(text):
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(rows, texts):
    """Pieces cover every document's ids once, offsets have no gaps, windows hold."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    found = Counter()
    for doc_id, pieces in by_doc.items():
        ids = defaultdict(list)
        for p in sorted(pieces, key=lambda p: p["start"]):
            ids[p["start"]].append(np.frombuffer(bytes(p["ids"]), dtype="<u4").tolist())
        for copies in ids.values():
            for part in copies:
                found[doc_id] += len(part)
        assert all(len(p["ids"]) == 4 * p["length"] > 0 for p in pieces)
    wanted = Counter()
    for doc_id, text in texts:
        wanted[doc_id] += len(reference_ids(text))
    assert found == wanted
    padded = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += p["length"]
        assert at <= pieces[0]["window"] <= 2048
        padded += at < pieces[0]["window"]
    return padded


def test_packing_awkward_rows(spark):
    frame = docs(spark, AWKWARD).coalesce(1)
    rows = packing.pack(frame, queries.VOCABULARY, block_tokens=1000).collect()
    assert check_pieces(rows, [(r[0], r[1]) for r in AWKWARD]) <= 1
    odd = AWKWARD[-1]
    pieces = sorted((r for r in rows if r["doc_id"] == odd[0]), key=lambda r: r["start"])
    joined = b"".join(bytes(p["ids"]) for p in pieces)
    assert np.frombuffer(joined, dtype="<u4").tolist() == reference_ids(odd[1])
    assert packing.pack(docs(spark, AWKWARD).limit(0), queries.VOCABULARY).count() == 0


def test_packing_whole_table(spark):
    source = table(spark, "documents")
    rows = packing.pack(source, queries.VOCABULARY).collect()
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    check_pieces(rows, list(texts.items()))
    whole = defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    for doc_id, parts in whole.items():
        ids = np.frombuffer(b"".join(b for _, b in sorted(parts)), dtype="<u4").tolist()
        assert ids == reference_ids(texts[doc_id])
    assert queries.op1(spark, SF).agg(F.sum("length")).first()[0] == sum(len(b) // 4 for p in whole.values() for _, b in p)


def test_packing_fills_long_windows_and_balances_steps(spark):
    packer = packing.Packer(0, packing.TIERS, 8192)
    for i in range(400):
        packer.add(i, b"\1\0\0\0" * (1 + (i * 37) % 1500))
    batch = packer.flush().to_pydict()
    totals, windows, steps = Counter(), {}, Counter()
    for s, n, w, g in zip(batch["sequence_id"], batch["length"], batch["window"], batch["step_group"]):
        totals[s] += n
        windows[s] = w
        steps[g] += n
    assert all(totals[s] == windows[s] for s in totals)
    assert max(steps.values()) - min(steps.values()) <= 2048
    assert len({w for w in windows.values()}) > 1


def test_a_frequent_word_is_encoded_once_however_many_rare_ones_pass():
    encode = packing.Encoder(queries.VOCABULARY, cached_words=20)
    model, asked = encode.model, []
    encode.model = SimpleNamespace(tokenize=lambda word: asked.append(word) or model.tokenize(word))
    text = " ".join(f"House {chr(97 + i // 26 % 26)}{chr(97 + i % 26)}x," for i in range(400))
    ids = np.frombuffer(encode(text), dtype="<u4").tolist()
    assert ids == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked.count("house") == 1 and len(encode.words.new) + len(encode.words.old) <= 40


def test_words_of_all_kinds_get_the_ids_of_the_library():
    encode = packing.Encoder(queries.VOCABULARY)
    texts = ["Don't 'tis O'Neil's x' 'x a'b 12 a1 1a ,a a, a,, É\u00df\u00b2 \u00c0\u00d7\u00f7 \u00aa\u00b5\u00ba",
             "a\x0bb\x0cc \x1cd \x85e\xa0f \xad g", "\u0130stanbul Stra\u00dfe \u01c5 na\u00efve", "the\tThe THE the. the's"]
    for text in [*texts, " ".join(texts)] * 2:
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == reference_ids(text)[:-1]


def test_plain_vocabularies_are_applied_whole():
    encode = packing.Encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    text = "Hello  world,\n it's 12"
    ids = np.frombuffer(encode(text), dtype="<u4").tolist()
    assert not encode.by_word and ids == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_language_awkward_rows(spark):
    words = {"en": "the house and water of this that which ", "de": "das haus und wasser der dieser welche nicht "}
    rows = [(i, words["en" if i % 2 else "de"] * (2 + i % 5), "en" if i % 2 else "de", "s") for i in range(100, 160)]
    frame = docs(spark, rows + AWKWARD).withColumn("lang_pred", F.lit("clash"))
    model = langid.fit(frame.filter("doc_id >= 100"))
    assert set(model) == {"en", "de"}
    found = langid.identify(frame, model)
    assert found.columns.count("lang_pred") == 1
    got = found.collect()
    assert len(got) == len(rows) + len(AWKWARD)
    for r in got:
        if r["text"] is None or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["lang_score"], r["lang_rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model and 0 <= r["lang_score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] >= 100:
            assert r["lang_pred"] == r["lang"] and not r["lang_rejected"]
    assert langid.fit(frame.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.identify(frame, {}).collect()} == {"und"}
    assert langid.identify(frame.limit(0), model).count() == 0


def test_language_held_out_accuracy(spark):
    found = queries.op2(spark, "/root/testdata/sf0.01").alias("f")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.join(truth, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95


def test_copies_and_common_beginnings_leave_no_language_thin(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 100)
    word = lambda i: "q" + "".join(chr(97 + int(c)) for c in f"{i:04d}")
    texts = [("xx", "all the same words " * 5)] * 5000 + [("xx", f"{word(i)} " * 20) for i in range(300)]
    texts += [("yy", "one license for each of them " * 50 + f"{word(i)} " * 600) for i in range(300)]
    texts += [("zz", "0123456789 " * 400 + f"{word(i)} " * 4) for i in range(300)]
    rows = [(i, text, lang, "s") for i, (lang, text) in enumerate(texts)]
    model = langid.fit(docs(spark, rows), 20_000)
    assert list(model) == ["xx", "yy", "zz"]
    found = {lang: len(set(re.findall(rb"q[a-j]{4}", content))) for lang, content in model.items()}
    # 78 excerpts are read; those of yy are long and fill the dictionary before.
    assert found["xx"] >= 70 and found["yy"] >= 15 and found["zz"] >= 70


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(prints))]


def test_simhash_awkward_rows(spark):
    got = simhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add((r["simhash"] & (2**64 - 1), r["component_id"]))
    for doc_id, text, *_ in AWKWARD:
        if text != LONG_TEXT:
            assert brute_fingerprint(text) in {f for f, _ in by_id[doc_id]}
    assert {c for _, c in by_id[2]} == {1} and {c for _, c in by_id[3]} == {c for _, c in by_id[5]} == {3}
    kept = simhash.keep_one(docs(spark, AWKWARD)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept if r["doc_id"] in (1, 2, 3, 4, 5)) == [(False, 1), (False, 3)]
    assert kept[0].__fields__ == docs(spark, AWKWARD).columns
    empty = docs(spark, AWKWARD).limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_simhash_against_brute_force(spark):
    rows = sorted(queries.op4(spark, SF).collect())
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    prints = [int(r["fingerprint"], 16) for r in rows]
    assert prints == [brute_fingerprint(texts[r["doc_id"]]) for r in rows]
    roots = brute_components(prints)
    least = defaultdict(lambda: 1 << 62)
    for r, root in zip(rows, roots):
        least[root] = min(least[root], r["doc_id"])
    assert [r["component_id"] for r in rows] == [least[root] for root in roots]


def test_trie_walk_holds_little():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 45_000, dtype=np.uint64))
    tracemalloc.start()
    try:
        assert sum(len(a) for a, _ in simhash.close_pairs(keys, keys, 2)) == 0
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20


def test_small_components_stay_in_few_files(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    edges = spark.range(0, 1000, 1, 4).select(F.col("id").alias("a"), F.expr("id div 10 * 10").alias("b"))
    try:
        for name, value in zip(names, ("40", "false")):
            spark.conf.set(name, value)
        got = graph.components(edges)
        assert got.rdd.getNumPartitions() <= 1 + 40
        found = {r["node"]: r["component"] for r in got.collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == {n: n // 10 * 10 for n in range(1000)}


def test_trie_finds_every_close_pair_across_subtrees(spark):
    noise = np.random.default_rng(3)
    base = noise.integers(0, 1 << 64, 150, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(b) for b in noise.integers(0, 64, 300)]
    keys = np.unique(np.concatenate([base, base ^ np.array(flips[:150]), base ^ np.array(flips[:150]) ^ np.array(flips[150:])]))
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    got = graph.components(simhash.links(frame, subtree=10)).collect()
    label = dict((r["node"], r["component"]) for r in got)
    roots = brute_components([int(k) for k in keys])
    groups = defaultdict(set)
    for k, root in zip(keys.view(np.int64), roots):
        groups[root].add(int(k))
    for members in groups.values():
        assert {label.get(m, m) for m in members} == {min(members)}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and len(got) == 361
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_awkward_rows(spark):
    frame = docs(spark, AWKWARD)
    sized = mixing.with_sizes(frame)
    assert sized.columns.count("size") == 1
    sizes = [(r["doc_id"], r["size"]) for r in sized.collect()]
    assert Counter(sizes) == Counter((r[0], len((r[1] or "").encode().split())) for r in AWKWARD)
    planned = mixing.plan(sized).collect()
    assert len(planned) == len(AWKWARD)
    total = sum(s for _, s in sizes)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in planned}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s for s, t in targets.values())
    assert all(0 <= r["copies"] <= 2 for r in planned)
    assert len({r["copies"] for r in planned if r["doc_id"] == 2}) == 1
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(
        x for r in planned for x in [r["doc_id"]] * r["copies"]
    )
    assert mixing.mix(frame.limit(0)).count() == 0
    blank = mixing.plan(mixing.with_sizes(docs(spark, [(1, "", "en", "a"), (2, None, "en", "b")]))).collect()
    assert [(r["target"], r["copies"]) for r in blank] == [(0.0, 0)] * 2


def brute_secrets(text):
    text = text or ""
    name = re.compile(secrets.ASSIGN.removeprefix("(?i)"), re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in name.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


KEY = "AKIA" + "Q7" * 8
SECRETS = [
    (1, "x password=abcdefgh1 y", "en", "a"),
    (2, "token: token: abcdefghij and \U0001f600 Api_Key = 'zzzzzzzz9'", "en", "b"),
    (3, f"{KEY} then {'0a' * 16} secret={'0b' * 20}", "en", "a"),
    (4, "PASSWD:short1 secret==abcdefgh " + "deadbeef" * 4, "en", "c"),
    (5, "bare abcdefgh1 here", "en", "a"),
    (6, "token=shared12345", "en", "a"),
    (7, "token=shared12345", "en", "b"),
    (8, "token=shared12345 shared12345", "en", "c"),
    (9, ("password=qwertyui%d " * 700) % tuple(range(700)), "en", "a"),
]


def brute_extra(rows):
    """Bare spans by document, in plain Python."""
    held = defaultdict(set)
    for _, text, _, source in rows:
        for a, k, b in brute_secrets(text):
            hit = (text or "")[a:b]
            held[re.fullmatch(secrets.ASSIGN.removeprefix("(?i)"), hit, re.I | re.A)[2] if k == 0 else hit].add((source, text))

    def few(pairs):
        return len({s for s, _ in pairs}) < 3 and len({t for _, t in pairs}) < 20

    def places(value, text):
        before, after = ("(?<![A-Za-z0-9])" if value[0].isalnum() else ""), ("(?![A-Za-z0-9])" if value[-1].isalnum() else "")
        return [m.span() for m in re.finditer(before + re.escape(value) + after, text or "")]

    live = [v for v, pairs in held.items() if few(pairs) and not re.match(secrets._ORDINARY, v)]
    live = [v for v in live if few({(s, t) for _, t, _, s in rows if places(v, t)})]
    extra = {}
    for doc_id, text, _, _ in rows:
        base = brute_secrets(text)
        found = {p for v in live for p in places(v, text) if not any(a < p[1] and p[0] < b for a, _, b in base)}
        extra[doc_id] = sorted(p for p in found if not any(o != p and o[0] <= p[0] and p[1] <= o[1] for o in found))
    return extra


def test_bare_values_against_brute_force_and_ordinary_words_stay(spark):
    rows = [
        (1, "the secret: everything", "en", "a"), (2, "we did everything and more", "en", "b"), (3, "token=Sunshine.", "en", "a"),
        (4, "Sunshine. SUNSHINE", "en", "a"), (5, "password: well-known", "en", "a"), (6, "a well-known one", "en", "b"),
        (7, "another well-known one", "en", "c"), (8, "secret=k9-Tq77xw", "en", "a"), (9, "k9-Tq77xw and xk9-Tq77xw, k9-Tq77xw", "en", "b"),
        *[(100 + i, f"sample {i}: api_key=demo-4242-key", "en", "a") for i in range(20)], (130, "use demo-4242-key", "en", "b"),
        *[(200 + i, "copied: token=copied-7777-key", "en", "a") for i in range(50)], (260, "see copied-7777-key", "en", "b"),
    ]
    got = {r["doc_id"]: r for r in secrets.report(secrets.scan(docs(spark, rows))).collect()}
    for doc_id, spans in brute_extra(rows).items():
        assert [s for s in got[doc_id]["spans"].split(",") if s.startswith("bare")] == [f"bare:{a}:{b}" for a, b in spans]
    assert got[9]["spans"] == "bare:0:9,bare:26:35" and got[260]["spans"] == "bare:4:19"
    # Twenty different texts of one owner share the sample: an example. Fifty copies of one text do not make one.
    assert got[100]["n_example"] == 1 and got[130]["spans"] == "" and got[200]["n_live"] == 1
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows)).collect()}
    assert [texts[i] for i in (2, 4, 6, 7, 130)] == [next(r[1] for r in rows if r[0] == i) for i in (2, 4, 6, 7, 130)]


CLASHING = "_id _of _live _mark _nth _kept _language _links _component _vector _rate _source _target _row _text base judged".split()


def test_stages_keep_columns_named_like_their_helpers(spark):
    rows = [(1, "x password=abcdefgh1 y", "en", "a"), (2, "bare abcdefgh1 here", "en", "a"), (3, None, None, None), (4, "", "en", "b")]
    frame = docs(spark, rows).withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in CLASHING})
    model = langid.fit(spark.createDataFrame([("good morning to you", "en")], "text string, lang string"))
    results = [
        langid.identify(frame, model), simhash.keep_one(frame), secrets.redact(frame), mixing.mix(frame),
        mixing.plan(mixing.with_sizes(frame)), corpus_pipeline.near_duplicates(spark, frame, ""),
    ]
    for result in results:
        assert set(frame.columns) <= set(result.columns)
        found = result.collect()
        assert found and all(r[c] == f"{c} {r['doc_id']}" for r in found for c in CLASHING)
    vectors = frame.select("*", F.lit(7).cast("long").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    found = neardup.near_duplicates(vectors).collect()
    assert len(found) == 4 and all(r[c] == f"{c} {r['doc_id']}" and r["n_links"] == 3 for r in found for c in CLASHING)


def test_numbers_that_are_words_for_patterns_are_no_letters(spark):
    model = langid.fit(spark.createDataFrame([("good morning to you", "en")], "text string, lang string"))
    rows = [(i, t) for i, t in enumerate(["\u00bd", "\u00b2 \u2167", "12_3", "good \u00bd", "\u00e9"])]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["und", "und", "und", "en", "en"]


def _with_awkward():
    return SECRETS + [(r[0] if r[0] is None else r[0] + 100, *r[1:]) for r in AWKWARD]


def test_secrets_against_brute_force(spark):
    rows = _with_awkward()
    got = secrets.report(secrets.scan(docs(spark, rows).withColumn("base", F.lit("clash")))).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        spans = brute_secrets(texts[r["doc_id"]])
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    by_id = {r["doc_id"]: r for r in got}
    # A live value is found without its name as well; a widely copied one is an example.
    assert by_id[5]["spans"] == "bare:5:14" and by_id[8]["spans"] == "assign:0:17"
    assert by_id[6]["n_example"] == 1 and by_id[1]["n_live"] == 1
    assert secrets.scan(docs(spark, AWKWARD).limit(0)).count() == 0


def test_redaction_keeps_all_rows_and_examples(spark):
    rows = _with_awkward()
    frame = docs(spark, rows)
    got = secrets.redact(frame).collect()
    assert len(got) == len(rows) and got[0].__fields__ == frame.columns
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[1] == "x [SECRET] y" and texts[8] == rows[7][1] and texts[5] == "bare [SECRET] here"
    assert texts[3] == "[SECRET] then [SECRET] [SECRET]" and texts[3 - 1].endswith("\U0001f600 [SECRET]'")
    assert texts[4] != rows[3][1] and "deadbeef" not in texts[4]


def test_live_values_are_found_whatever_stands_around_them(spark):
    named = ["password: correct-horse-battery", "token=hunter2hunter2", "secret: abcdefgh1", "secret: ab/cd=efgh==", "token: correct-horse"]
    bare = [
        ("so correct-horse-battery it is", "so [SECRET] it is"),
        ("It was hunter2hunter2.", "It was [SECRET]."),
        ("x/abcdefgh1 y=abcdefgh1,", "x/[SECRET] y=[SECRET],"),
        ("at x/ab/cd=efgh==.", "at x/[SECRET]."),
        ("xcorrect-horse-battery hunter2hunter23 abcdefgh", "xcorrect-horse-battery hunter2hunter23 abcdefgh"),
    ]
    rows = [(i, text, "en", "a") for i, text in enumerate(named, 1)]
    rows += [(10 + i, text, "en", "b") for i, (text, _) in enumerate(bare)] + [(None, bare[1][0], "en", "b")] * 2
    texts = sorted((r["doc_id"] or 99, r["text"]) for r in secrets.redact(docs(spark, rows)).collect())
    assert [t for i, t in texts if i in range(10, 20)] == [t for _, t in bare]
    assert texts[-2:] == [(99, bare[1][1])] * 2
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(secrets.scan(docs(spark, rows))).collect()}
    assert spans[10] == "bare:3:24" and spans[12] == "bare:2:11,bare:14:23" and spans[14] == ""


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    folder = "/root/testdata/sf0.01"  # the smallest documents hold no secret
    duck = duckdb.connect()
    for view in ("documents", "pages", "embeddings", "conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {view} AS SELECT * FROM '{folder}/{view}.parquet'")
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    frame = queries.QUERIES[name](spark, folder)
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in frame.columns]
    wanted = Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
    assert Counter(tuple(r) for r in frame.collect()) == wanted


def test_pipeline_reads_texts_in_small_batches(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 2000)").alias("text"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        assert sum(p["length"] for p in corpus_pipeline.STAGES[-1][1](spark, texts, "").collect()) == 3000 * 2001

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

        found = texts.mapInArrow(sizes, "bytes long, rows long").collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r["rows"] for r in found) == 3000
    assert max(r["bytes"] for r in found) < 5 << 20


def test_pipeline_against_its_stages_by_hand(spark):
    """The same stages in plain Python over the same model and the same draw."""
    source = table(spark, "documents")
    rows = [r.asDict() for r in source.collect()]
    model = langid.fit(source.filter(langid.learned_from()))
    known = langid.Classifier(model)
    kept = []
    for r in rows:
        lang, _, margin = known(r["text"])
        if lang != "und" and margin >= langid.MARGIN:
            kept.append({**r, "lang": lang})
    roots = brute_components([brute_fingerprint(r["text"]) for r in kept])
    first = {}
    for r, root in zip(kept, roots):
        if root not in first or r["doc_id"] < first[root]["doc_id"]:
            first[root] = r
    kept = list(first.values())
    owners = defaultdict(set)
    for r in kept:
        for start, kind, end in brute_secrets(r["text"]):
            owners[_value(r["text"][start:end], kind)].add(r["source"])
    for r in kept:
        r["text"] = _redacted(r["text"], owners)
    size = lambda r: len(r["text"].encode().split())
    by_source = Counter()
    for r in kept:
        by_source[r["source"]] += size(r)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by_source))}
    level, total = 0.0, 1.5 * sum(by_source.values())
    for _ in by_source:
        full = {s for s in by_source if 2 * by_source[s] <= level * weights[s]}
        level = (total - sum(2 * by_source[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
    wanted = Counter()
    for r in kept:
        rate = min(2 * by_source[r["source"]], level * weights[r["source"]]) / by_source[r["source"]]
        draw = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        wanted[r["doc_id"]] += (int(rate) + (draw < rate - int(rate))) * len(reference_ids(r["text"]))
    got = Counter()
    for p in corpus_pipeline.run(spark, SF).select("doc_id", "length").collect():
        got[p["doc_id"]] += p["length"]
    assert got == +wanted


def _value(span, kind):
    if kind:
        return span
    return re.fullmatch(secrets.ASSIGN.removeprefix("(?i)"), span, re.I | re.A)[2]


def _redacted(text, owners):
    base = brute_secrets(text)
    spans = [(a, b) for a, k, b in base if len(owners[_value(text[a:b], k)]) < 3]
    for m in re.finditer(r"[A-Za-z+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*", text):
        apart = all(m.end() <= a or b <= m.start() for a, _, b in base)
        if apart and len(m[0]) >= 8 and m[0] in owners and len(owners[m[0]]) < 3:
            spans.append(m.span())
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]
