"""Finds benchmark items in documents, also with other numbers, names and units.

Texts become templates: numbers, names and units turn into typed placeholders, all other words count in
lower case, punctuation not at all. Windows of eight template words are hashed and joined with those
of the benchmark. Where a matched window has placeholders, its slots are checked: within one alignment
of item and document, each value of the item must stand for one value of the document throughout.
Windows that hold a value for which this fails do not count; those without it do, and so do windows that
are equal word for word. A capitalised word that opens a sentence is both a plain word and, in windows of
a second kind, a name. In scripts without blanks each character is a word.

A document holds an item when matched windows are half of those that can tell the item, or when windows
equal word for word are half of all its windows or cover three quarters of its words. An item of one or
two words must be a whole sentence or line.

Documents are cut into words once. Each window of the benchmark is probed by its rarest plain word, then
by its next rarest, and only where both are there is the window itself compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import box, quoted, unboxed
from revlens.sources.stages import StageStore

WIDTH = 8
MIN_WIDTH = 3
# words of a window that must not be placeholders, out of eight
MIN_LITERALS = 4
COVER_PERCENT = 50
COVER_WORDS_PERCENT = 75
# bytes of benchmark windows that go to every task at once; a larger benchmark takes turns
BLOCK_BYTES = 64 << 20
# a word or number with the end of a sentence or line before it, if there is one
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
# the first range is in the others too: it is there for speed
TOKEN = (
    rf"(?:[.!?\n]\s*)?(?:[A-Za-zÀ-ÖØ-öø-ÿ[\p{{L}}\p{{M}}&&[^{UNSPACED}]]]++"
    rf"|[0-9]++(?:[.,:/][0-9]++)*+|[%$]|[\p{{L}}\p{{M}}&&[{UNSPACED}]])"
)
OPENING = ".!?\n\r\t "
# fixed values: words and signs that count as units
UNITS = (
    "% $ € £ ¥ ° mm cm m km mg g kg t ml l s ms min h hz khz mhz ghz w kw mw v kv pa kpa bar j kj cal kcal "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre "
    "kilometres centimeter centimeters gram grams kilogram kilograms pound pounds ounce ounces ton tons liter "
    "liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months "
    "year years dollar dollars cent cents euro euros degree degrees percent"
).split()
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = "<number>", "<name>", "<unit>"


def raw_tokens(text: str) -> Column:
    """Words, numbers and signs in order; one that opens a sentence or line keeps the end before it."""
    opened = F.concat(F.lit("\n"), F.coalesce(quoted(text), F.lit("")))
    return F.regexp_extract_all(opened, F.lit(TOKEN), F.lit(0))


def template(token: Column) -> Column:
    """Most words start with a small letter, so that case comes out first."""
    bare = F.ltrim(token, F.lit(OPENING))
    inner = F.substring(token, 2, 1)
    capital = ((token >= "A") & (token < "[")) | (token >= "À")
    special = (
        F.when((bare >= "0") & (bare < ":"), F.lit(NUMBER_SLOT))
        .when(bare.isin("%", "$"), F.lit(UNIT_SLOT))
        .when(capital & (inner >= "a") & ((inner < "À") | (inner >= "à")), F.lit(NAME_SLOT))
        .otherwise(F.lower(bare))
    )
    plain = (token >= "a") & ((token < "À") | (token >= "à"))
    return F.when(~plain, special).when(token.isin(UNITS), F.lit(UNIT_SLOT)).otherwise(token)


# kinds of windows: openings as plain words, openings as names, no placeholders at all
TEMPLATE, NAMED, VERBATIM = 0, 1, 2


def worded(tokens: Column, kind: int) -> Column:
    """What tokens count as in windows of a kind."""
    if kind == TEMPLATE:
        return F.transform(tokens, template)
    bare = F.transform(tokens, lambda token: F.ltrim(token, F.lit(OPENING)))
    return F.transform(bare, template if kind == NAMED else F.lower)


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER_SLOT, NAME_SLOT, UNIT_SLOT)


def bare(token: Column) -> Column:
    return F.lower(F.ltrim(token, F.lit(OPENING)))


def _item_windows(items: DataFrame, kind: int) -> DataFrame:
    """The windows of a kind of every item; an item shorter than eight words is one window."""
    items = items.withColumn("words", worded(F.col("tokens"), kind)).withColumn("kind", F.lit(kind))
    items = items.withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("width"))
    cut = items.select("item_id", "tokens", "words", "kind", "width", F.explode(starts).alias("bpos"))
    run = F.slice("words", F.col("bpos") + 1, F.col("width"))
    slots = F.lit(0) if kind == VERBATIM else F.size(F.filter(run, is_slot))
    return cut.select(
        "item_id",
        "tokens",
        "kind",
        "width",
        "bpos",
        run.alias("run"),
        (F.col("width") - slots).alias("literals"),
        F.slice("tokens", F.col("bpos") + 1, F.col("width")).alias("item_run"),
    )


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """The windows that can tell an item, with the two words of each that it is probed by.

    Templates need three words and, of eight, four that are no placeholders; n_windows counts the places
    where there is such a window, or all places of an item that has none. All windows count word for word.
    """
    items = benchmark.select(quoted(item_id).alias("item_id"), raw_tokens(text).alias("tokens"))
    items = items.where(F.size("tokens") > 0).dropDuplicates(["item_id", "tokens"])
    windows = _item_windows(items, TEMPLATE).union(_item_windows(items, NAMED))
    windows = windows.where(
        (F.col("width") >= MIN_WIDTH) & (F.col("literals") * WIDTH >= F.col("width") * MIN_LITERALS)
    )
    told = windows.select("item_id", "bpos").distinct()
    telling = told.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_telling"))
    plain = _item_windows(items, VERBATIM)
    counts = plain.groupBy("item_id").agg(
        F.count_distinct("bpos").alias("n_places"), F.max(F.size("tokens")).alias("n_words")
    )
    both = windows.union(plain).join(told.withColumn("telling", F.lit(True)), ["item_id", "bpos"], "left")
    both = both.join(counts, "item_id").join(telling, "item_id", "left")
    # how often a word is in the benchmark says which word of a window is rare; it only steers the work
    tally = items.select(F.explode(F.transform("tokens", bare)).alias("word")).groupBy("word").count()
    placed = both.select("*", F.posexplode("item_run").alias("at", "token"), F.xxhash64("item_id", "tokens").alias("_copy"))
    usable = placed.where(~is_slot(F.get("run", F.col("at")))).withColumn("word", bare(F.col("token")))
    rarity = F.struct(F.col("count"), -F.length("word"), F.col("at"), F.xxhash64("word").alias("hash"))
    probes = (
        usable.join(tally, "word")
        .groupBy("item_id", "_copy", "kind", "bpos")
        .agg(F.slice(F.sort_array(F.collect_list(rarity)), 1, 2).alias("rare"))
    )
    both = both.withColumn("_copy", F.xxhash64("item_id", "tokens"))
    second = F.coalesce(F.get("rare", F.lit(1)), F.get("rare", F.lit(0)))
    return both.join(probes, ["item_id", "_copy", "kind", "bpos"]).select(
        "item_id",
        "kind",
        "width",
        "bpos",
        F.xxhash64("run").alias("window"),
        (F.col("literals") < F.col("width")).alias("has_slots"),
        _slot_values(F.col("item_run")).alias("item_values"),
        F.coalesce("n_telling", "n_places").alias("n_windows"),
        (F.col("n_telling").isNull() | F.col("telling").isNotNull()).alias("telling"),
        "n_places",
        "n_words",
        F.col("rare")[0]["hash"].alias("probe"),
        F.col("rare")[0]["at"].alias("probe_at"),
        second["hash"].alias("second"),
        second["at"].alias("second_at"),
    )


def _slot_values(run: Column) -> Column:
    """The values of the placeholders of a run of the column `kind`, in lower case and null elsewhere."""
    words = F.when(F.col("kind") == NAMED, worded(run, NAMED)).otherwise(worded(run, TEMPLATE))
    return F.zip_with(
        words, run, lambda word, token: F.when(is_slot(word), F.lower(F.ltrim(token, F.lit(OPENING))))
    )


def _window_hits(words: DataFrame, windows: DataFrame, store: StageStore, name: str) -> DataFrame:
    """Where windows of the benchmark are in documents: probed by two words, then compared whole.

    The probes are written before windows are compared. Comparing takes functions of arrays that cannot
    be compiled; pushed into the join, they would have every word carry its text out of the compiled scan.
    """
    near = words.join(F.broadcast(windows), F.col("word") == F.col("probe"))
    start = F.col("at") - F.col("probe_at")
    inside = (start >= 0) & (start + F.col("width") <= F.size("tokens"))
    near = near.where(inside & (F.xxhash64(bare(F.get("tokens", start + F.col("second_at")))) == F.col("second")))
    near = near.select(
        "doc_id",
        "content",
        *[name for name in windows.columns if not name.startswith(("probe", "second"))],
        (start - F.col("bpos")).alias("shift"),
        F.slice("tokens", start + 1, F.col("width")).alias("run"),
        # a sentence or line ends where a word has the end of one before it, or where the text ends
        (_opens(F.get("tokens", start)) & F.coalesce(_opens(F.get("tokens", start + F.col("width"))), F.lit(True))).alias("whole"),
    )
    near = store.save(near, f"probed_{name}")
    run = F.col("run")
    hashed = (
        F.when(F.col("kind") == VERBATIM, F.xxhash64(worded(run, VERBATIM)))
        .when(F.col("kind") == NAMED, F.xxhash64(worded(run, NAMED)))
        .otherwise(F.xxhash64(worded(run, TEMPLATE)))
    )
    # windows of two kinds that are equal are equal as templates, so slots are those of the item
    named = F.transform(run, lambda token: F.lower(F.ltrim(token, F.lit(OPENING))))
    slots = F.arrays_zip(F.col("item_values").alias("item_value"), named.alias("doc_value"))
    same = (hashed == F.col("window")) & (F.col("whole") | (F.col("n_words") >= MIN_WIDTH))
    hits = near.where(same).withColumn("slots", F.when(F.col("has_slots"), slots))
    return store.save(hits.drop("run", "whole", "window", "item_values"), f"hits_{name}")


def _opens(token: Column) -> Column:
    return F.left(token, F.lit(1)).isin(".", "!", "?", "\n")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    store: StageStore,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item it holds: doc_id, content, item_id, n_windows, n_matched,
    n_changed_slots.

    `content` is a hash of the text, so that rows of one doc_id with different texts stay apart;
    repeated rows give one answer. n_changed_slots counts the item's slot values that the document
    gives another value; 0 for a verbatim passage. Null or empty texts hold nothing, a null doc_id is
    an id like any other, an item with a null id is passed over. An empty table on either side gives
    an empty result. Texts are read whole.
    """
    windows = store.save(benchmark_windows(benchmark.where(quoted(item_id).isNotNull()), item_id, item_text), "items")
    size = windows.agg(F.sum(F.lit(96) + F.octet_length(F.array_join("item_values", " ")))).first()[0] or 0
    plain = docs.select(
        quoted(doc_id).alias("doc_id"), raw_tokens(text).alias("tokens"), F.xxhash64(quoted(text)).alias("content")
    )
    # an inner explode would have its array computed once more, for a filter of empty arrays
    words = plain.select("doc_id", "content", "tokens", F.posexplode_outer("tokens").alias("at", "token"))
    words = words.withColumn("word", F.xxhash64(bare(F.col("token"))))
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = []
    for block in range(blocks):
        own = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("item_id", "bpos"), F.lit(blocks)) == block)
        parts.append(_window_hits(words, own, store, str(block)))
    hits = reduce(DataFrame.unionByName, parts)
    aligned = (
        hits.where("has_slots")
        .select("doc_id", "content", "item_id", "kind", "shift", "bpos", F.posexplode("slots").alias("offset", "slot"))
        .where("slot.item_value is not null")
        .select(
            "doc_id",
            "content",
            "item_id",
            "kind",
            "shift",
            (F.col("bpos") + F.col("offset")).alias("at"),
            "slot.item_value",
            "slot.doc_value",
        )
        .distinct()
    )
    alignment = ["doc_id", "content", "item_id", "kind", "shift"]
    one_value = F.col("least") == F.col("most")
    checked = (
        aligned.groupBy(*alignment, "item_value")
        .agg(
            F.min("doc_value").alias("least"),
            F.max("doc_value").alias("most"),
            F.max((F.col("item_value") != F.col("doc_value")).cast("int")).alias("changed"),
            F.collect_set("at").alias("places"),
        )
        .groupBy(*alignment)
        .agg(
            F.flatten(F.collect_list(F.when(~one_value, F.col("places")))).alias("unfit"),
            F.sum(F.when(one_value, F.col("changed")).otherwise(0)).alias("changed"),
        )
        .select(
            F.col("doc_id").alias("d"),
            F.col("content").alias("c"),
            F.col("item_id").alias("i"),
            F.col("kind").alias("k"),
            F.col("shift").alias("s"),
            "unfit",
            "changed",
        )
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("d"))
        & (F.col("content") == F.col("c"))
        & (F.col("item_id") == F.col("i"))
        & (F.col("kind") == F.col("k"))
        & (F.col("shift") == F.col("s"))
    )
    held = F.exists("unfit", lambda at: at.between(F.col("bpos"), F.col("bpos") + F.col("width") - F.lit(1)))
    consistent = hits.join(checked, same, "left").where(~F.coalesce(held, F.lit(False)))
    places = consistent.groupBy("doc_id", "content", "item_id", "n_windows", "n_places", "n_words", "bpos").agg(
        F.min(F.coalesce("changed", F.lit(0))).alias("changed"),
        F.bool_or("telling").alias("telling"),
        F.max(F.when(F.col("kind") == VERBATIM, F.col("width"))).alias("same_width"),
    )
    # the words that windows equal word for word cover; as many as an item has at most
    covered = F.array_distinct(
        F.flatten(
            F.collect_list(
                F.when(
                    F.col("same_width").isNotNull(),
                    F.sequence(F.col("bpos"), F.col("bpos") + F.col("same_width") - F.lit(1)),
                )
            )
        )
    )
    judged = places.groupBy("doc_id", "content", "item_id", "n_windows", "n_places", "n_words").agg(
        F.count_if("telling").alias("n_matched"),
        F.max("changed").alias("n_changed_slots"),
        F.count("same_width").alias("n_same"),
        F.size(covered).alias("n_covered"),
    )
    holds = (
        (F.col("n_matched") * 100 >= F.col("n_windows") * COVER_PERCENT)
        | (F.col("n_same") * 100 >= F.col("n_places") * COVER_PERCENT)
        | (F.col("n_covered") * 100 >= F.col("n_words") * COVER_WORDS_PERCENT)
    )
    return judged.where(holds).select("doc_id", "content", "item_id", "n_windows", "n_matched", "n_changed_slots")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, store: StageStore, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` without the rows that hold a benchmark item; all other rows stay as they are."""
    found = contaminated(docs, benchmark, store, doc_id, text)
    found = store.save(found.select("doc_id", "content").distinct().toDF("_held_id", "_held_content"), "contaminated")
    keyed = docs.select(box(docs), quoted(doc_id).alias("_own_id"), F.xxhash64(quoted(text)).alias("_own_content"))
    same = F.col("_own_id").eqNullSafe(F.col("_held_id")) & (F.col("_own_content") == F.col("_held_content"))
    return keyed.join(found, same, "left_anti").select(*unboxed(docs.columns, ()))
