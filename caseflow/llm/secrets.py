"""Secrets in texts, judged by how many owners share a value, in DataFrame operations only.

Candidates are found by pattern and identified by the hash of their value. The corpus is then
asked how many distinct repositories and owners hold each value: one that many owners share is a
widely copied example, one of few owners looks live. Live values are also found where they stand
without a telling name before them, whatever they are made of: anywhere but inside a longer word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import free, replace_columns, stored

# The patterns of the three kinds, in their order, and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "bare")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

# A run of the longest kind that ends where the class ends is the same as a run of any length that
# is long enough, so these two need no filter afterwards.
_LONG_ACCESS = r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4)
_LONG_HEX = r"[0-9a-f]{%d,}" % LEAST_HEX
# A value consists of words and the characters between them.
_WORD = r"[A-Za-z0-9]"
# An ordinary word, with punctuation around it, that somebody may use as a password.
_ORDINARY = r"^[+/_.=-]*(?:[A-Za-z]?[a-z]*|[A-Z]*)[+/_.=-]*$"
_BLOCK = 256


def _running(column: str) -> Column:
    """Running sums of an array of numbers, by blocks, so that long arrays stay affordable."""
    values = F.col(column)

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)

    last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    sums = F.transform(blocks, total)
    inside = F.transform(
        blocks,
        lambda block, b: F.transform(
            block, lambda _, i: total(F.slice(sums, F.lit(1), b)) + total(F.slice(block, F.lit(1), i + 1))
        ),
    )
    return F.when(F.size(values) > 0, F.flatten(inside)).otherwise(F.array().cast("array<bigint>"))


def _found(df: DataFrame, text: str, kind: str, pattern: str | Column, group: int = 0) -> DataFrame:
    """Add ``_kind``: an array of (start, end, value) of all matches, in order.

    The pieces between matches and the matches themselves give the positions.
    """
    at = F.lit(pattern) if isinstance(pattern, str) else pattern
    lengths = F.transform(
        F.arrays_zip(F.col(f"_{kind}_gaps").alias("gap"), F.col(f"_{kind}_all").alias("match")),
        lambda x: (F.length(x["gap"]) + F.length(x["match"])).cast("long"),
    )
    df = df.withColumns(
        {
            f"_{kind}_all": F.regexp_extract_all(text, at, 0),
            f"_{kind}_value": F.regexp_extract_all(text, at, group),
            f"_{kind}_gaps": F.split(F.col(text), at, F.lit(-1)),
        }
    )
    df = df.withColumn(f"_{kind}_gaps", F.slice(f"_{kind}_gaps", F.lit(1), F.size(f"_{kind}_all")))
    df = df.withColumn(f"_{kind}_steps", lengths).withColumn(f"_{kind}_ends", _running(f"_{kind}_steps"))
    spans = F.transform(
        F.arrays_zip(
            F.col(f"_{kind}_ends").alias("end"), F.col(f"_{kind}_all").alias("match"), F.col(f"_{kind}_value").alias("value")
        ),
        lambda x: F.struct(
            (x["end"] - F.length(x["match"])).alias("start"),
            x["end"].alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.sha2(x["value"], 256).alias("hash"),
            F.length(x["value"]).alias("chars"),
            x["value"].alias("value"),
        ),
    )
    return df.withColumn(f"_{kind}", spans).drop(*[f"_{kind}_{x}" for x in ("all", "value", "gaps", "steps", "ends")])


_SPAN = "array<struct<start:bigint,end:bigint,kind:int,hash:string,chars:int,value:string>>"


def _suspect(text: Column) -> Column:
    """Cheap test that no text with a base span fails."""
    return text.contains("AKIA") | text.rlike(_LONG_HEX) | text.rlike(ASSIGN)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``: the spans of the three kinds (start, end, kind, hash, chars, value), by start.

    Positions count code points, ends are exclusive. NULL text counts as empty.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_text", whole)
    df = df.withColumn("_base_text", F.when(_suspect(F.col("_text")), F.col("_text")))
    df = _found(df, "_base_text", "assign", ASSIGN, 2)
    df = _found(df, "_base_text", "access", _LONG_ACCESS)
    df = _found(df, "_base_text", "hex", _LONG_HEX)
    none = F.array().cast(_SPAN)
    named = F.filter("_assign", lambda s: s["chars"] >= LEAST_VALUE)
    df = df.withColumn("_base", F.coalesce(F.array_sort(F.concat(named, "_access", "_hex")), none).cast(_SPAN))
    found = replace_columns(df, {"base": F.col("_base")})
    return found.drop("_text", "_base_text", "_assign", "_access", "_hex", "_base")


def ownership(found: DataFrame, repository: str, owner: str, example_owners: int, example_repositories: int) -> DataFrame:
    """(hash, value, repositories, owners, live) of every value of a base span: ``live`` if it has both fewer owners
    and fewer repositories than an example.

    Grouping by value, owner and repository first keeps a value that is everywhere from meeting in
    one task. NULL owners or repositories count as one.
    """
    value = ["hash", "value"]
    spread = (
        found.select(F.explode("base").alias("_s"), F.col(owner).alias("_owner"), F.col(repository).alias("_repo"))
        .select("_s.hash", "_s.value", "_owner", "_repo")
        .groupBy(*value, "_owner", "_repo")
        .agg(F.lit(1).alias("_one"))
        .groupBy(*value, "_owner")
        .agg(F.count(F.lit(1)).alias("_repos"))
    )
    counted = spread.groupBy(*value).agg(F.sum("_repos").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    few = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    return counted.withColumn("live", few)


def _longest_word(value: Column) -> Column:
    """The longest word of a value; a value without one stands for itself."""
    words = F.regexp_extract_all(value, F.lit(_WORD + "+"), F.lit(0))
    sized = F.transform(words, lambda w: F.struct(F.length(w).alias("chars"), w.alias("word")))
    return F.coalesce(F.array_max(sized)["word"], value)


def _alone(value: Column) -> Column:
    """Pattern of a value that is not part of a longer word."""
    before = F.when(value.rlike("^" + _WORD), F.lit(f"(?<!{_WORD})")).otherwise(F.lit(""))
    after = F.when(value.rlike(_WORD + "$"), F.lit(f"(?!{_WORD})")).otherwise(F.lit(""))
    # No value holds a backslash.
    return F.concat(before, F.lit("\\Q"), value, F.lit("\\E"), after)


def bare(rows: DataFrame, owners: DataFrame, example_owners: int, example_repositories: int) -> DataFrame:
    """(doc_id, mark, bare): where live values stand in texts, of every text with at least one.

    A text is asked for a value only if it holds the longest word of it. Only such texts are read again. Ordinary
    words are not looked for, and a value that stands in the texts of as many owners or repositories as an
    example, named or not, is part of the language and not found here.
    """
    live = owners.filter("live").filter(~F.col("value").rlike(_ORDINARY)).select(
        _longest_word(F.col("value")).alias("word"), F.struct("value", "owners", "repositories").alias("_known")
    )
    plain = live.filter(F.col("word").rlike(_WORD))
    least = plain.agg(F.min(F.length("word"))).first()[0] or LEAST_VALUE
    word = "%s{%d,}+|[+/_.=-]{%d,}+" % (_WORD, least, LEAST_VALUE)
    words = rows.select(
        "doc_id", "mark", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(0)))).alias("word")
    )
    asked = words.join(live, "word").groupBy("doc_id", "mark").agg(F.collect_set("_known").alias("_known"))
    # Written once, so that its size is known when the texts are joined.
    asked = stored(asked, "secret-words").withColumnsRenamed({"doc_id": "_id", "mark": "_of"})
    texts = rows.select("doc_id", "mark", "_holder", "_repository", F.col("text").alias("_bare_text"))
    each = texts.join(asked, texts["doc_id"].eqNullSafe(asked["_id"]) & (texts["mark"] == asked["_of"])).select(
        "doc_id", "mark", "_holder", "_repository", "_bare_text", F.explode("_known").alias("_known")
    )
    placed = _found(each, "_bare_text", "bare", _alone(F.col("_known.value")))
    spans = placed.filter(F.size("_bare") > 0).drop("_bare_text").withColumn("_value", F.col("_known.value"))
    # Written once: it is read for the count of holders and for the spans.
    spans = stored(spans, "secret-bare")
    held = (
        spans.groupBy("_value", "_holder", "_repository").agg(F.lit(1).alias("_one"))
        .groupBy("_value", "_holder").agg(F.count(F.lit(1)).alias("_held"))
        .groupBy("_value").agg(F.count(F.lit(1)).alias("_owners"), F.sum("_held").alias("_repositories"))
    )
    common = held.filter((F.col("_owners") >= example_owners) | (F.col("_repositories") >= example_repositories))
    spans = spans.join(common.select("_value"), "_value", "left_anti")
    spans = spans.select("doc_id", "mark", "_known", F.explode("_bare").alias("_span")).select(
        "doc_id", "mark",
        F.struct("_span.start", "_span.end", "_span.kind", F.lit(True).alias("live"), "_known.owners", "_known.repositories").alias("_span"),
    )
    return spans.groupBy("doc_id", "mark").agg(F.collect_set("_span").alias("bare"))


def _text_of(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(
    docs: DataFrame, repository: str | None = None, owner: str = "source", example_owners: int = 3, example_repositories: int = 20
) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, base, extra and judged.

    ``base`` holds the spans found by pattern, ``extra`` the ones the corpus adds: bare occurrences
    of live values outside all base spans, of those within each other the longest. ``judged`` has every base and extra span with its value's
    repositories, owners and ``live``: fewer than ``example_owners`` distinct owners and fewer than
    ``example_repositories`` distinct repositories hold it. Without a column for them, texts are the repositories, so
    that copies of a document make no example of its secrets. ``mark`` is a hash of the text. Bare occurrences
    of ordinary words, and of values as common as examples, are no spans.

    * NULL or empty text: no spans. Repeated rows: equal results, and one repository and owner.
    * NULL doc_id or owner: kept, counted as one repository or owner.
    * An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(
        "doc_id", (F.xxhash64("text") if repository is None else F.col(repository)).alias("_repository"),
        F.col(owner).alias("_holder"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark"),
    )
    narrow = candidates(rows).drop("text").withColumn("_row", F.monotonically_increasing_id())
    # Written once: row numbers stay the same whatever is computed again later.
    narrow = stored(narrow, "secret-candidates")
    owners = stored(ownership(narrow, "_repository", "_holder", example_owners, example_repositories), "secret-owners")
    spans = narrow.select("_row", F.explode("base").alias("_span")).select("_row", "_span.*")
    judged = (
        spans.join(owners.drop("value"), "hash")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "live", "owners", "repositories"))).alias("judged"))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,live:boolean,owners:bigint,repositories:bigint>>")
    loose = bare(rows, owners, example_owners, example_repositories).withColumnsRenamed({"doc_id": "_id", "mark": "_of"})
    joined = narrow.join(judged, "_row", "left").join(
        loose, narrow["doc_id"].eqNullSafe(loose["_id"]) & (narrow["mark"] == loose["_of"]), "left"
    )
    apart = F.filter(
        F.coalesce("bare", none), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    joined = joined.withColumn("_apart", apart)
    outer = F.filter(
        "_apart",
        lambda s: ~F.exists(
            "_apart",
            lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"]),
        ),
    )
    joined = joined.withColumn("extra", F.array_sort(outer))
    every = F.array_sort(F.concat(F.coalesce("judged", none), "extra")).alias("judged")
    own = F.transform("base", lambda s: F.struct(*[s[x].alias(x) for x in ("start", "end", "kind", "hash", "chars")]))
    return joined.select("doc_id", "mark", own.alias("base"), "extra", every)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests per row of ``scan``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    by_place = F.array_sort(
        F.transform("judged", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    own = F.array_sort(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_text_of(own), 256).alias("base_sha256"),
        _text_of(by_place).alias("spans"),
        F.size(F.filter("judged", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def _without(text: Column, spans: Column, sign: str) -> Column:
    """The text with every span replaced by a sign; overlapping spans leave one sign."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        before = F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        apart = span["start"] >= state["at"]
        parts = F.when(apart, F.concat(state["parts"], F.array(before, F.lit(sign)))).otherwise(state["parts"])
        return F.struct(parts.alias("parts"), F.greatest(state["at"], span["end"]).alias("at"))

    return F.aggregate(
        spans, start, step,
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, (s["at"] + 1).cast("int"))),
    )


def redact(docs: DataFrame, sign: str = "[SECRET]", **how) -> DataFrame:
    """The documents with live secrets replaced by a sign; widely copied examples stay.

    Every row and column is kept, whatever the names. The table of spans is written first: while it is small, no
    text is moved to be joined with it. NULL and empty texts stay, repeated rows are treated alike, an empty
    table stays empty.
    """
    found = scan(docs, **how)
    key, of, spans, mark = free(docs, "_id", "_of", "_live", "_mark")
    live = F.filter("judged", lambda s: s["live"])
    marks = (
        found.select(F.col("doc_id").alias(key), F.col("mark").alias(of), live.alias(spans))
        .filter(F.size(spans) > 0)
        .groupBy(key, of)
        .agg(F.first(spans).alias(spans))
    )
    marks = stored(marks, "secret-marks")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    joined = marked.join(marks, marked["doc_id"].eqNullSafe(marks[key]) & (marked[mark] == marks[of]), "left")
    cleaned = F.when(F.col(spans).isNotNull(), _without(F.col("text"), F.col(spans), sign)).otherwise(F.col("text"))
    return joined.withColumn("text", cleaned).select(*[f"`{c}`" for c in docs.columns])
