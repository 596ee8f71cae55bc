"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

The edit unit is the word and the bound is one edit (a word replaced, added or
left out) for lines of at least ``MIN_WORDS`` words, none for shorter ones. A
line's deletion neighbourhood, itself and each way to leave out one word, is
emitted as hashed keys: two lines within the bound share a key, at the same
place of the word left out, or as one line's whole and the other's variant.
Lines of over ``LONG`` words are compared by all but one of their stretches of
``STRETCH`` words first, instead of by halves, and leave out only words of a
stretch that may hold the edit, so that a line of any length is judged whole.
Matches are verified word by word. A line goes if an earlier one, in order of
document and line, lies within the bound.

Only lines that share an end of 4, 8 or 16 words (``EDGES``, by their length),
and then half of their words, with another line are emitted: one edit cannot
touch both ends. Equal lines count as one,
and keys are reduced to their earliest line before anything is joined back, so
no group of lines is ever paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sieve import marked
from .store import write_table

MIN_WORDS = 8
#: Words of the ends that lines are compared by first: at most half of the words of a line.
EDGES = (4, 8, 16)
#: Lines of more words are compared by stretches of so many.
LONG, STRETCH = 256, 64
_LAST = (1 << 63) - 1


def _clean(text: Column) -> Column:
    """White space runs as one blank and none at the ends of lines; texts that are so already are only looked at."""
    untidy = F.lit(False)
    for mark in ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c"):
        untidy = untidy | F.contains(text, F.lit(mark))
    tidied = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n ?", "\n")
    return F.btrim(F.when(untidy, tidied).otherwise(text), F.lit(" "))


def units(text: Column) -> Column:
    """The lines of a text, white space runs as one blank; blank lines are empty."""
    return F.split(_clean(F.coalesce(text, F.lit(""))), "\n")


def _identity(unit: str) -> Column:
    """128 bits that stand for a line: among a trillion lines, two that are not the same share them with a probability of 1e-15."""
    return F.unhex(F.md5(unit))


def _place(doc: str = "doc", at: str = "at") -> Column:
    return F.struct(F.col(doc), F.col(at))


_ENDS = ("first", "last", "other_first", "other_last")


def _ends() -> list[Column]:
    """Hashes of the ends of ``unit`` of ``n`` words; a line whose next shorter one has shorter ends shows those, too."""

    def end(words: Column, first: bool) -> Column:
        return F.xxhash64(words, F.lit(first), F.call_function("substring_index", F.col("unit"), F.lit(" "), words if first else -words))

    n = F.col("n")
    own, other = F.lit(None).cast("int"), F.lit(None).cast("int")
    for shorter, words in zip((None, *EDGES), EDGES):
        own = F.when(n >= 2 * words, F.lit(words)).otherwise(own)
        if shorter:
            other = F.when(n == 2 * words, F.lit(shorter)).otherwise(other)
    both = [(own, True), (own, False), (other, True), (other, False)]
    return [F.when(words.isNotNull(), end(words, first)).alias(name) for name, (words, first) in zip(_ENDS, both)]


def _duplicates(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines ``(doc, text_key, n_units, at, line)`` of ``source``, and ``(line, times, owner)`` of those with several."""
    blank = F.col("unit") == ""
    n_words = F.octet_length("unit") - F.octet_length(F.replace("unit", F.lit(" "), F.lit(""))) + 1
    split = source.select("doc", "text_key", units(F.col("text")).alias("units")).withColumn("n_units", F.size("units"))
    # Here and below generators are outer ones: Spark guards the others by filters that work the array out once more.
    lines = split.select("doc", "text_key", "n_units", F.posexplode_outer("units").alias("at", "unit")).filter(~blank)
    lines = lines.select("doc", "text_key", "n_units", "at", _identity("unit").alias("line"), n_words.cast("int").alias("n"), "unit")
    lines = write_table(lines.select("doc", "text_key", "n_units", "at", "line", "n", *_ends()), "lines")
    distinct = lines.groupBy("line").agg(
        F.min(_place()).alias("place"), F.count("*").alias("times"), F.max("n").alias("n"), *(F.max(c).alias(c) for c in _ENDS)
    )
    distinct = write_table(distinct, "lines-distinct")
    able = distinct.filter(F.col("n") >= MIN_WORDS)
    edges = able.select("line", F.explode(F.array(*_ENDS)).alias("edge")).filter("edge IS NOT NULL")
    # Written before it is joined by the same key, here and below: a crowded key can then be split.
    several = write_table(edges.groupBy("edge").agg(F.count("*").alias("m")).filter("m > 1").select("edge"), "lines-edges")
    chosen = edges.join(several, "edge", "left_semi").select("line").distinct()
    chosen = write_table(able.join(chosen, "line", "left_semi").select("line", "place"), "lines-chosen")
    # Their words, from the document where each occurs first.
    wanted = chosen.groupBy(F.col("place.doc").alias("doc")).agg(F.collect_set("place.at").alias("ats"))
    asked = write_table(chosen.select(F.col("place.doc").alias("key")).distinct(), "lines-asked")
    texts = marked(source.select("doc", "text"), F.col("doc"), asked).filter("__may").drop("__may")
    texts = texts.join(wanted.hint("shuffle_hash"), "doc")  # sorts no texts
    texts = texts.select("doc", "ats", F.posexplode_outer(units(F.col("text"))).alias("at", "unit"))
    texts = texts.filter(F.array_contains("ats", F.col("at"))).withColumn("line", _identity("unit"))
    texts = texts.join(chosen, "line").filter(_place() == F.col("place")).withColumn("words", F.split("unit", " "))
    # Rows repeated under one id show their lines at the same places: one of them is enough.
    words = write_table(texts.select("line", "place", "words").dropDuplicates(["line"]), "lines-words")
    near = _near(words)
    owners = distinct.join(near, "line", "left")
    owners = owners.filter("times > 1 OR near IS NOT NULL").select("line", "times", F.least("place", F.coalesce("near", "place")).alias("owner"))
    return lines, write_table(owners, "lines-owners")


def _sharing_halves(words: DataFrame) -> DataFrame:
    """``line, early, late`` of lines that share half of themselves with another line of the same or the next number of words.

    One edit leaves the first or the last half of the shorter line untouched, so
    a line shows its halves for its own number of words and for one word less.
    ``early`` and ``late`` tell where the edit can be.
    """

    def halves(n: Column) -> list[Column]:
        half = F.floor(n / 2).cast("int")
        first = F.slice("words", F.lit(1), half)
        last = F.slice("words", F.size("words") - (n - half) + 1, n - half)
        return [F.struct(F.xxhash64(n, F.lit(late), x).alias("half"), F.lit(late).alias("late")) for late, x in ((True, first), (False, last))]

    n = F.size("words")
    shown = words.select("line", F.inline_outer(F.array(*halves(n), *halves(n - 1))))
    several = write_table(shown.groupBy("half").agg(F.count("*").alias("m")).filter("m > 1").select("half"), "lines-halves")
    sharing = shown.join(several, "half", "left_semi").groupBy("line")
    return sharing.agg(F.max(~F.col("late")).alias("early"), F.max("late").alias("late"))


def _sharing_stretches(words: DataFrame) -> DataFrame:
    """``line, stretches``: the stretches of a line without which it is the same as another of the same or the next number of words.

    The words before a stretch are counted from the left and those behind it from the right, for the line's own number
    of words and for one less: an edit inside the stretch moves neither.
    """
    n = F.size("words")

    def shown(c: Column) -> Column:
        def key(ref: Column) -> Column:
            behind = F.greatest(ref - (c + 1) * STRETCH, F.lit(0))
            return F.xxhash64(ref, c, F.slice("words", F.lit(1), F.least(c * STRETCH, n)), F.slice("words", n - behind + 1, behind))

        return F.array(*[F.struct(c.alias("stretch"), key(ref).alias("rest")) for ref in (n, n - 1)])

    stretches = F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / STRETCH).cast("int")), shown))
    rows = write_table(words.select("line", F.inline_outer(stretches)), "lines-stretches")
    several = write_table(rows.groupBy("rest").agg(F.count("*").alias("m")).filter("m > 1").select("rest"), "lines-rests")
    return rows.join(several, "rest", "left_semi").groupBy("line").agg(F.collect_set("stretch").alias("stretches"))


def _near(words: DataFrame) -> DataFrame:
    """``(line, near)``: the earliest place of another line within one edit, where there is one."""
    halves = _sharing_halves(words.filter(F.size("words") <= LONG)).withColumn("stretches", F.lit(None).cast("array<int>"))
    # A line of just so many words can be an edit away from a longer one.
    longer = _sharing_stretches(words.filter(F.size("words") >= LONG)).withColumns({"early": F.lit(False), "late": F.lit(False)})
    shares = halves.unionByName(longer).groupBy("line").agg(F.max("early").alias("early"), F.max("late").alias("late"), F.max("stretches").alias("stretches"))
    words = write_table(words.join(shares, "line"), "lines-open")
    hashed = words.select("line", "early", "late", "stretches", F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    n = F.size("w")
    middle = F.floor((n + 1) / 2).cast("int")
    short = F.sequence(F.when(F.col("early"), 1).otherwise(F.floor((n - 1) / 2).cast("int") + 1), F.when(F.col("late"), n).otherwise(middle))
    none = F.array().cast("array<int>")
    inside = F.transform(
        "stretches", lambda c: F.when(c * STRETCH < n, F.sequence(c * STRETCH + 1, F.least((c + 1) * STRETCH, n))).otherwise(none)
    )
    without = F.transform(
        F.when(n <= LONG, short).otherwise(F.flatten(inside)),
        lambda i: F.struct(
            # The hash runs over the elements of both parts as over those of one array.
            F.xxhash64(n - 1, F.slice("w", F.lit(1), i - 1), F.slice("w", i + 1, n)).alias("key"), i.alias("gap")
        ),
    )
    whole = F.array(F.struct(F.xxhash64(n, "w").alias("key"), F.lit(0).alias("gap")))
    emitted = write_table(hashed.select("line", F.inline_outer(F.concat(whole, without))), "lines-variants")
    # Only keys that several rows share go on, with the places of their lines.
    several = write_table(emitted.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "lines-keys")
    shared = emitted.join(several, "key", "left_semi").join(words.select("line", "place"), "line")
    shared = write_table(shared, "lines-shared")
    earliest = F.min(F.struct("place", "line"))
    # Replaced word: variants with the same gap. Of the whole lines of a key there is one.
    same = shared.filter("gap > 0").groupBy("key", "gap").agg(earliest.alias("best"), F.count("*").alias("m")).filter("m > 1")
    # Added or missing word: one line's whole is the other's variant.
    by_key = shared.groupBy("key").agg(
        F.min(F.when(F.col("gap") == 0, F.struct("place", "line"))).alias("whole"),
        F.min(F.when(F.col("gap") > 0, F.struct("place", "line"))).alias("variant"),
    )
    by_key = by_key.filter("whole IS NOT NULL AND variant IS NOT NULL")
    replaced = shared.join(same.select("key", "gap", "best"), ["key", "gap"]).select("line", "place", "best")
    other = F.when(F.col("gap") == 0, F.col("variant")).otherwise(F.col("whole"))
    resized = shared.join(by_key, "key").select("line", "place", other.alias("best"))
    found = replaced.unionByName(resized).filter(F.col("best.place") < F.col("place"))
    found = found.groupBy("line").agg(F.min("best").alias("best")).select("line", F.col("best.place").alias("near"), F.col("best.line").alias("other"))
    # Verified on the words themselves.
    mine = words.select("line", F.col("words").alias("a"))
    theirs = words.select(F.col("line").alias("other"), F.col("words").alias("b"))
    return found.join(mine, "line").join(theirs, "other").filter(within_one("a", "b")).select("line", "near")


def within_one(a: str, b: str) -> Column:
    """Whether two word arrays are at most one word edit apart: their common ends leave at most one word."""
    longest, shortest = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differs == 0, shortest).otherwise(F.least(differs - 1, shortest))

    ends = common(F.col(a), F.col(b)) + common(F.reverse(a), F.reverse(b))
    return (longest - shortest <= 1) & (ends >= longest - 1)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    return docs.select(doc.alias("doc"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))


def _removed(source: DataFrame) -> DataFrame:
    """``doc, text_key, n_units, gone`` of documents with words: how many lines, and the numbers of those that go, in order."""
    lines, owners = _duplicates(source)
    # Lines that hold more than a thousandth of all rows, a thousand at most, are joined map-side.
    frequent = F.col("times") > F.lit(max(1, lines.count() // 1000))
    heavy = F.broadcast(owners.filter(frequent).select("line", "owner"))
    rest = lines.join(heavy.select("line"), "line", "left_anti").join(owners.filter(~frequent).select("line", "owner"), "line", "left")
    found = lines.join(heavy, "line").unionByName(rest)
    goes = F.when(_place() > F.col("owner"), F.col("at"))
    return found.groupBy("doc", "text_key").agg(F.max("n_units").alias("n_units"), F.array_sort(F.collect_set(goes)).alias("gone"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, removed``, the last as line numbers joined by commas.

    Lines are numbered from 0, blank ones too, which never go. Defined cases: a
    null or empty text is one blank line; a line repeated inside a document goes
    from its second occurrence on; rows repeated with one id and text share
    their places and do not remove each other's lines; a null id sorts behind
    all ids; an empty table gives an empty result; other columns are not read.
    Lines are the same where 128 bits of them are (``_identity``); a collision of the 64-bit keys that candidates are
    found by can only keep a line, as what goes by an edit is verified word by word.
    """
    source = _source(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), breaks.alias("breaks"))
    rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    return rows.join(_removed(source), ["doc", "text_key"], "left").select(
        "doc_id",
        F.coalesce("n_units", F.col("breaks") + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the duplicate lines left out of their texts; texts that lose none stay as they are."""
    gone = write_table(_removed(_source(docs, id_col, text_col)).filter(F.size("gone") > 0).select("doc", "text_key", "gone"), "lines-gone")
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    packed = packed.select("row", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.col("row")[text_col]).alias("text_key"))
    sieved = marked(packed, F.col("doc"), gone.select(F.col("doc").alias("key")))  # only texts that may lose lines are dealt by id
    some = sieved.filter("__may").join(gone, ["doc", "text_key"], "left").select("row", "gone")
    rest = sieved.filter(~F.col("__may")).select("row", F.lit(None).cast("array<int>").alias("gone"))
    own = F.col("row")[text_col]
    kept = F.filter(units(own), lambda _, k: ~F.array_contains("gone", k))
    text = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(kept, "\n"))
    return some.unionByName(rest).select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
