"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents lose the marks around them and their
case; numbers, names and units become typed placeholders, so a question asked
again with other values has the same template. Every WINDOW consecutive
template words of an item (all of a shorter item) are looked up in the
documents by hash joins. A matching window counts if its slots are consistent:
equal slot values in the item stand for equal values in the document. A
document is contaminated by an item if at least MIN_SHARE of the item's windows
are found, or a run of RUN consecutive words, or an edited copy: items between
WINDOW and 2 RUN words long are also looked up by seeds, windows of at most half
the item, and around each seed that is found the item's words are compared one
by one, moved by up to one word, of which at least MIN_WORDS must be there. So
one word changed, added or dropped anywhere in an item of more than WINDOW
words leaves it found. Items of up to WINDOW words must be there as a whole.

The lookup goes through each window's anchor, the word that fewest windows of
the benchmark hold: document words are joined with the anchors, and only where
one stands is the window around it formed, hashed and compared. All steps are
DataFrame functions. The anchors are met in blocks of at most ANCHOR_BLOCK
rows, each broadcast: a larger benchmark takes more passes over the documents,
and never a shuffle of their words. Names are told only in texts that can hold a
window with names: those whose literal words hold the window's core, its longest
run of words without placeholders (``core_words``).

Item and document are compared in several readings (READINGS), each with its
own windows, and a window found in any of them is found: literal words with
numbers alone replaced, which letter case and white space do not change, and
templates with names, which are told by their capitals. A capital at the start
of a sentence or after a mark may or may not be a name's, so one reading takes
it for a name and one does not. Names side by side are one name, so names of
several words match names of one. Windows are counted by the words of the item
that they cover, which are the same in all readings.

Defined results: null or empty text matches nothing; items without words are
ignored; rows that share an item_id are one item, and rows that share a doc_id
one document (a null doc_id is reported as null); an empty table gives an empty
result; only doc_id, text and item_id, text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
MIN_SHARE = 0.5
#: Consecutive words of an item that are enough.
RUN = 13
#: Share of a short item's words that an edited copy keeps.
MIN_WORDS = 0.85
#: Rows of an anchor block: the size bound of what is broadcast.
ANCHOR_BLOCK = 50_000
#: Bits of the bitmap that goes ahead of a join, for each key in it.
KEY_BITS = 16

#: Unit words after a number.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons",
    "pound", "pounds", "ml", "l", "litre", "litres", "liter", "liters", "second", "seconds", "minute", "minutes", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents",
]

#: Placeholders: characters of the private use area, which no pattern below takes for a letter or a mark.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: Marks before and after a name while a text is read, and between the words of one name.
_OPEN, _CLOSE, _JOIN = "\ue003", "\ue004", "\ue005"
#: A word that holds one of them.
_SLOT = "[\ue000-\ue005]"

_BLANK = r"[\x20\x09-\x0D]"
_MARK = r"[^\p{L}\p{N}\x20\x09-\x0D\x{E000}-\x{E005}]"
#: The marks around a word; the lookahead lets all other characters fail at once.
_AROUND = rf"(?={_MARK})(?:(?<![^\x20\x09-\x0D]){_MARK}++|(?<!{_MARK}){_MARK}++(?={_BLANK}|$))"
#: White space that is not one single space.
_RAGGED = rf"[\x09-\x0D]{_BLANK}*+|\x20{_BLANK}++"
#: A capitalised word after a word or a comma, so not the first of its sentence.
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;][\x20]\p{Lu})\p{Ll}++(?!\p{L})"
#: Any capitalised word.
_CAPITALISED = r"(?<!\p{L})\p{Lu}\p{Ll}++(?!\p{L})"
_NUMBER = r"(?<![^\x20\x09-\x0D])[^\p{N}\x20\x09-\x0D]*+\p{N}[^\x20\x09-\x0D]*+"
_UNIT = rf"{NUMBER}[\x20](?:{'|'.join(UNITS)})(?={_BLANK}|$)"


#: What is taken for a name in each reading; the reading without names leaves units as they are.
READINGS = [None, _NAME, _CAPITALISED]


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _RAGGED, " "))


def _bare(text: Column, names: str | None) -> Column:
    spaced = _spaced(text)
    if names:
        spaced = F.replace(F.regexp_replace(spaced, names, f"{_OPEN}$0{_CLOSE}"), F.lit(f"{_CLOSE} {_OPEN}"), F.lit(_JOIN))
    return F.lower(F.regexp_replace(spaced, _AROUND, ""))


def _split(text: Column) -> Column:
    return F.split(_spaced(text), " ")


def value_words(text: Column, names: str | None = None) -> Column:
    """The words of a text without the marks around them, in lower case; the words of a name are one."""
    bare = _bare(text, names)
    return _split(F.translate(bare, _OPEN + _CLOSE, "") if names else bare)


def template_words(text: Column, names: str | None = _NAME) -> Column:
    """As many words as ``value_words``, with placeholders for numbers and, if ``names`` is given, for names and units."""
    bare = _bare(text, names)
    if not names:
        return _split(F.regexp_replace(bare, _NUMBER, NUMBER))
    bare = F.regexp_replace(bare, f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}", NAME)
    return _split(F.regexp_replace(F.regexp_replace(bare, _NUMBER, NUMBER), _UNIT, f"{NUMBER} {UNIT}"))


def _readings(text: Column) -> Column:
    """(reading, t, v) rows: the text's template words and its value words in each reading."""
    rows = []
    for reading, names in enumerate(READINGS):
        rows.append(F.struct(F.lit(reading).alias("reading"), template_words(text, names).alias("t"), value_words(text, names).alias("v")))
    return F.inline(F.array(*rows))


def _slots(template: Column) -> Column:
    return F.exists(template, lambda w: w.isin(NAME, NUMBER, UNIT))


def _literal_words(values: Column) -> Column:
    """The number of words, each word of a name counted."""
    joined = F.array_join(values, "")
    return F.size(values) + F.length(joined) - F.length(F.replace(joined, F.lit(_JOIN), F.lit("")))


def core_words(template: Column) -> Column:
    """The longest run of consecutive words of a template that hold no placeholder; empty if there is none.

    A word without a placeholder is read alike in all readings, and two of them that stand side by side in one reading
    do so in all. So a text that holds a window in any reading holds the window's core in its literal words.
    """
    words = F.transform(template, lambda w: F.when(w.rlike(_SLOT), F.lit("\n")).otherwise(w))
    runs = F.transform(F.split(F.array_join(words, " "), "\n"), lambda r: F.filter(F.split(r, " "), lambda w: w != ""))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.size(r).alias("n"), F.length(F.array_join(r, "")).alias("chars"), r.alias("run"))))
    return longest["run"]


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, part, reading, seed, nth, start, stop, length, whash, has_slots, template, item_values, t, v): the
    windows of all items in all readings, from literal word ``start`` to before ``stop``; ``part`` tells different
    texts of one item apart. Seeds have the item's words ``t`` and ``v`` with them."""
    texts = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text").distinct()
    words = texts.select("item_id", F.xxhash64("text").alias("part"), _readings(F.col("text")))
    words = words.filter(F.array_join("t", "") != "")
    whole = F.struct(F.lit(False).alias("seed"), F.least(F.size("t"), F.lit(window)).alias("length"))
    half = F.struct(F.lit(True).alias("seed"), F.least(F.expr("size(t) div 2"), F.lit(window)).alias("length"))
    kinds = F.when(F.size("t").between(window + 1, 2 * RUN), F.array(whole, half)).otherwise(F.array(whole))
    cut = words.select("item_id", "part", "reading", "t", "v", F.inline(kinds))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("length"))).alias("nth"))
    cut = cut.select(
        "item_id", "part", "reading", "seed", "length", "nth",
        F.slice("t", F.col("nth") + 1, F.col("length")).alias("template"), F.slice("v", F.col("nth") + 1, F.col("length")).alias("item_values"),
        _literal_words(F.slice("v", F.lit(1), F.col("nth"))).alias("start"), F.when(F.col("seed"), F.col("t")).alias("t"), F.when(F.col("seed"), F.col("v")).alias("v"),
    )
    cut = cut.withColumn("stop", F.col("start") + _literal_words(F.col("item_values")))
    cut = cut.withColumn("whash", F.xxhash64(F.array_join("template", " ")))
    return stored(cut.withColumn("has_slots", _slots(F.col("template"))), "item-windows")


def anchored(windows: DataFrame) -> DataFrame:
    """(reading, whash, length, has_slots, whole, seed, core, anchor, at): the different windows of each reading with the
    word by which they are looked up, and among those of the literal reading the cores of all windows with names; the
    flags tell what a window is in the items that have it."""
    kinds = [F.col("has_slots"), (~F.col("seed")).alias("whole"), F.col("seed"), F.lit(False).alias("core")]
    pieces = windows.select("reading", "whash", "template", *kinds)
    cores = windows.filter("reading > 0").select(core_words(F.col("template")).alias("template")).filter("size(template) > 0")
    no = F.lit(False)
    cores = cores.select(F.lit(0).alias("reading"), F.xxhash64(F.array_join("template", " ")).alias("whash"), "template", no, no, no, ~no)
    pieces = pieces.union(cores).groupBy("reading", "whash", "template").agg(*[F.max(c).alias(c) for c in ("has_slots", "whole", "seed", "core")])
    pieces = stored(pieces.withColumn("length", F.size("template")), "window-pieces")
    # The anchor: the window's word that fewest windows hold, the longest of those, the first of those.
    held = pieces.select("*", F.posexplode("template").alias("at", "anchor")).drop("template")
    common = stored(held.groupBy("reading", "anchor").agg(F.count(F.lit(1)).alias("windows")), "item-words")
    best = Window.partitionBy("reading", "whash").orderBy("windows", F.desc(F.length("anchor")), "at", "anchor")
    held = held.join(common, ["reading", "anchor"]).withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return stored(held.drop("rank", "windows"), "anchors")


def _found_windows(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, th, reading, whash, first, has_slots, whole, seed, core): the windows in rows of (doc_id, th, reading, t)."""
    places = words.select("doc_id", "th", "reading", "t", F.posexplode_outer("t").alias("place", "anchor"))
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    hits = []
    for block in range(blocks):
        some = anchors.filter(F.pmod(F.xxhash64("whash"), F.lit(blocks)) == block)
        met = places.join(F.broadcast(some), ["reading", "anchor"]).withColumn("first", F.col("place") - F.col("at"))
        met = met.filter("first >= 0 and first + length <= size(t)")
        met = met.filter("xxhash64(array_join(slice(t, first + 1, length), ' ')) = whash")
        hits.append(met.select("doc_id", "th", "reading", "whash", "first", "has_slots", "whole", "seed", "core"))
    return reduce(DataFrame.union, hits)


def maybe_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, th) is among ``wanted``, and a few others: so a join of the texts with all of
    ``wanted`` moves few texts. Only a bitmap with KEY_BITS bits or more for each wanted key is broadcast."""
    bits = 1 << max(15, (KEY_BITS * wanted.count() - 1).bit_length())
    place = F.pmod(F.xxhash64("doc_id", "th"), F.lit(bits))
    marks = wanted.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_marks"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_marks", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(stored(marks, "wanted-marks")), "_bucket")
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def window_hits(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (doc_id, th, reading, whash, first, has_slots, whole, seed): item windows found in documents, at word
    ``first``, ``th`` the hash of the text; and (doc_id, th, text), the texts that may hold windows with names or whose
    hits are to be compared.

    All texts are read literally; with names only those that hold the core of a window with names. A window without
    any literal word has no core: if there is one, all texts are read with names.
    """
    anchors = anchored(windows)
    docs = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), "text")
    literal = docs.select("doc_id", "th", F.lit(0).alias("reading"), template_words(F.col("text"), None).alias("t"))
    hits = stored(_found_windows(literal, anchors.filter("reading = 0")), "literal-hits")
    texts = docs
    if windows.filter("reading > 0").filter(F.size(core_words(F.col("template"))) == 0).isEmpty():
        wanted = stored(hits.filter("core or has_slots or seed").select("doc_id", "th").distinct(), "texts-wanted")
        texts = maybe_wanted(docs, wanted).alias("d").hint("merge").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id and d.th = w.th"), "left_semi")
    texts = stored(texts.dropDuplicates(["doc_id", "th"]), "candidate-texts")
    named = [F.struct(F.lit(i).alias("reading"), template_words(F.col("text"), names).alias("t")) for i, names in enumerate(READINGS) if names]
    named = texts.select("doc_id", "th", F.inline(F.array(*named)))
    hits = hits.filter("whole or seed").union(_found_windows(named, anchors.filter("reading > 0")))
    return stored(hits.drop("core"), "window-hits"), texts


def hit_texts(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, th, reading, doc_t, doc_v): the template and value words of the texts whose hits are to be compared."""
    wanted = stored(hits.filter("has_slots or seed").select("doc_id", "th", "reading").distinct(), "compared")
    few = wanted.select("doc_id", "th").distinct().alias("w")
    texts = texts.alias("d").join(few, F.expr("d.doc_id <=> w.doc_id and d.th = w.th"), "left_semi")
    words = texts.select("doc_id", "th", _readings(F.col("text"))).alias("t")
    words = words.join(wanted.alias("w"), F.expr("t.doc_id <=> w.doc_id and t.th = w.th and t.reading = w.reading"), "left_semi")
    return stored(words.select("doc_id", "th", "reading", F.col("t").alias("doc_t"), F.col("v").alias("doc_v")), "hit-texts")


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    same = F.expr("r.doc_id <=> x.doc_id and r.th = x.th and r.reading = x.reading")
    # The texts grow with the documents, so the join is a shuffled one at every size.
    return rows.alias("r").join(texts.alias("x").hint("merge"), same).select("r.*", "x.doc_t", "x.doc_v")


def consistent(template: Column, item_values: Column, doc_values: Column) -> Column:
    """Equal slot values of the item stand for equal values of the document."""
    slots = F.filter(F.arrays_zip(template.alias("t"), item_values.alias("i"), doc_values.alias("d")), lambda s: s["t"].isin(NAME, NUMBER, UNIT))
    pairs = F.transform(slots, lambda s: F.struct(s["t"].alias("t"), s["i"].alias("i"), s["d"].alias("d")))
    sources = F.transform(slots, lambda s: F.struct(s["t"].alias("t"), s["i"].alias("i")))
    return F.size(F.array_distinct(pairs)) == F.size(F.array_distinct(sources))


def words_kept() -> Column:
    """How many of the words ``t`` of a seed's item are in the document, at their places or one beside; slots with a
    value that contradicts another's do not count."""
    place = F.col("first") - F.col("near") - F.col("nth")  # of the item's first word in near_t

    def beside(word: Column, i: Column) -> Column:
        return F.coalesce(*[F.when(F.get("near_t", place + i + by) == word, place + i + by) for by in (0, 1, -1)])

    pairs = F.transform("t", lambda w, i: F.struct(w.alias("t"), F.get("v", i).alias("i"), beside(w, i).alias("at")))
    pairs = F.filter(pairs, lambda p: p["at"].isNotNull())
    slots = F.filter(pairs, lambda p: p["t"].isin(NAME, NUMBER, UNIT))
    sources = F.transform(slots, lambda p: F.struct(p["t"].alias("t"), p["i"].alias("i")))
    both = F.transform(slots, lambda p: F.struct(p["t"].alias("t"), p["i"].alias("i"), F.get("near_v", p["at"]).alias("d")))
    return F.size(pairs) - (F.size(F.array_distinct(both)) - F.size(F.array_distinct(sources)))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, windows_found, windows_total, share) of each contaminated document and item; an edited copy of
    a short item may have few windows or none."""
    windows = item_windows(benchmark, window)
    totals = windows.filter("reading = 0 and not seed").select("item_id", "part", "nth").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("windows_total"))
    totals = stored(totals, "item-totals")
    hits, texts = window_hits(docs, windows)
    texts = hit_texts(texts, hits)
    keys = ["reading", "whash", "item_id", "part", "nth"]
    lookup = stored(windows.filter("not seed").select(*keys, "length", "start", "stop", "has_slots", "template", "item_values").distinct(), "window-lookup")
    found = hits.filter("whole").drop("has_slots").join(lookup, ["reading", "whash"])
    told = ["doc_id", "reading", "item_id", "part", "nth", "first", "start", "stop"]
    slots = _with_texts(found.filter("has_slots"), texts).withColumn("doc_values", F.slice("doc_v", F.col("first") + 1, F.col("length")))
    slots = slots.filter(consistent(F.col("template"), F.col("item_values"), F.col("doc_values")))
    matched = found.filter("not has_slots").select(*told).union(slots.select(*told))
    # Windows that stand side by side in item and document lie on one diagonal.
    covered = F.sequence("start", F.greatest("start", F.col("stop") - window))  # the literal windows in a window
    places = F.struct("nth", covered.alias("covered"))
    diagonal = matched.groupBy("doc_id", "item_id", "part", "reading", (F.col("first") - F.col("nth")).alias("diagonal"))
    diagonal = diagonal.agg(F.collect_set(places).alias("places"))
    side_by_side = max(1, RUN - window + 1)
    nths = F.transform("places", lambda p: p["nth"])
    run = F.exists(nths, lambda n: F.size(F.array_intersect(nths, F.sequence(n, n + side_by_side - 1))) == side_by_side)
    covered_here = F.flatten(F.transform("places", lambda p: p["covered"]))
    matched = diagonal.select("doc_id", "item_id", "part", run.alias("enough"), F.explode(covered_here).alias("nth"))
    # Around seeds.
    lookup = windows.filter("seed").select(*keys, "length", "has_slots", "template", "item_values", "t", "v", F.size("t").alias("seed_size")).distinct()
    seeds = hits.filter("seed").drop("has_slots").join(stored(lookup, "seed-lookup"), ["reading", "whash"])
    seeds = _with_texts(seeds, texts).withColumn("doc_values", F.slice("doc_v", F.col("first") + 1, F.col("length")))
    seeds = seeds.filter(~F.col("has_slots") | consistent(F.col("template"), F.col("item_values"), F.col("doc_values")))
    seeds = seeds.withColumn("near", F.greatest(F.col("first") - F.col("nth") - 1, F.lit(0)))
    around = [F.slice(c, F.col("near") + 1, F.col("seed_size") + 2) for c in ("doc_t", "doc_v")]
    seeds = seeds.withColumns({"near_t": around[0], "near_v": around[1]}).drop("doc_t", "doc_v")
    edited = seeds.filter(words_kept() >= MIN_WORDS * F.col("seed_size"))
    edited = edited.select("doc_id", "item_id", F.lit(None).cast("long").alias("part"), F.lit(True).alias("enough"), F.lit(None).cast("int").alias("nth"))
    found = matched.union(edited).groupBy("doc_id", "item_id", "part", "nth").agg(F.max("enough").alias("enough"))
    found = found.groupBy("doc_id", "item_id").agg(F.count("nth").alias("windows_found"), F.max("enough").alias("enough"))
    share = F.col("windows_found") / F.col("windows_total")
    out = found.join(totals, "item_id").filter((share >= min_share) | F.col("enough"))
    return out.select("doc_id", "item_id", "windows_found", "windows_total", share.alias("share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents, with the columns of docs; a document without doc_id is told by its text."""
    key = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.sha2("text", 256)))
    found = contaminated(docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark)
    found = stored(found.select(F.col("doc_id").alias("_found")).distinct(), "contaminated")
    return docs.join(found, key == found["_found"], "left_anti")
