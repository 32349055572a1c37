"""Benchmark decontamination by template canonicalisation.

Every word of a text becomes a template word: numbers, quantities, units after
a number and names become typed placeholders (slots), other words lose outer
punctuation and case.  Windows of ``window`` template words of the documents
are hash-joined with those of the benchmark.  For the places where windows
meet, template words are compared in full and the slots must be consistent:
on one alignment, equal benchmark values stand for equal document values and
different ones for different ones, as in a question asked again with other
numbers and names.  A document with at least ``min_words`` consistent words of
an item is contaminated; of an item of no more words ``share`` of them will do, as a
name that opens it is an ordinary word there and a slot behind other words (an
item shorter than a window, which meets as a whole, needs all).

Only DataFrame functions.  Texts are canonicalised by regular expressions over
the whole text, window hashes are built by doubling (two hashes of k words
give one of 2k), and only the places that matched are ever exploded to words.

Defined results: a null or empty text is clean; an empty benchmark leaves all
documents clean; repeated rows are judged alike; items shorter than a window
are matched by windows of their own length; benchmark windows with fewer than
``min_fixed`` ordinary words (or all of a shorter window's) are matched by
their exact words, slot values included and case aside, as slots alone
identify nothing (nor do windows without a letter or digit, which do not
count); extra columns are kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WINDOW, MIN_WORDS, MIN_FIXED = 8, 13, 4
#: Share of a short item's words that must be consistent.
SHARE = 0.8
#: Window hashes of the benchmark up to which they are broadcast.
BROADCAST_WINDOWS = 2_000_000
BROADCAST_KEYS = 200_000

#: Units that may follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "miles", "mile", "meters", "metres", "feet", "inches", "mg", "g", "kg", "lb",
         "lbs", "oz", "pounds", "grams", "ml", "l", "liters", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h", "hr",
         "hours", "days", "weeks", "months", "years", "kmh", "mph", "w", "kw", "kwh", "j", "kj", "cal", "kcal", "v", "a", "hz", "khz",
         "mhz", "ghz", "b", "kb", "mb", "gb", "tb", "usd", "eur", "gbp", "dollars", "cents", "euros", "percent", "degrees")

# marks of a slot (private-use characters): OPEN type value CLOSE
OPEN, CLOSE = "\ue000", "\ue001"
_PUNCT = rf"[^\p{{L}}\p{{N}} {OPEN}{CLOSE}]"
_UNIT = "(?i:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")"
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"


def _spaced(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__t``: the words of the text with one space before, between and after them."""
    t = F.col("__t")
    marked = F.contains(t, F.lit(OPEN)) | F.contains(t, F.lit(CLOSE))
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__t", F.when(marked, F.translate(t, OPEN + CLOSE, "??")).otherwise(t))
    # only white space that is not a single space already is rewritten
    df = df.withColumn("__t", F.regexp_replace(t, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))
    return df.withColumn("__t", F.concat(F.lit(" "), F.trim(t), F.lit(" ")))


def with_exact(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text's words, space-joined between two spaces, lower-cased, without outer punctuation (one of punctuation alone stays)."""
    t = F.col("__t")
    df = _spaced(df, text).withColumn("__t", F.regexp_replace(t, rf"(?<= ){_PUNCT}++(?=[\p{{L}}\p{{N}}])", ""))
    return df.withColumn(out, F.lower(F.regexp_replace(t, rf"(?<=[\p{{L}}\p{{N}}]){_PUNCT}++(?= )", ""))).drop("__t")


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text's words, space-joined between two spaces, lower-cased, with slots as OPEN type value CLOSE.

    A word outside a slot keeps its letters and digits (one of punctuation
    alone is empty).  Each step is a column, so that none is computed twice.
    """
    t = F.col("__t")
    df = _spaced(df, text)
    # a capitalised word is a name unless it opens the text or a sentence
    df = df.withColumn("__t", F.regexp_replace(t, rf"(?<=[^ .!?:] ){_PUNCT}*+(\p{{Lu}}\p{{L}}*+){_PUNCT}*+(?= )", f"{OPEN}p$1{CLOSE}"))
    n = F.regexp_replace(t, rf"(?<= ){_PUNCT}*({_NUMBER}){_PUNCT}*(?= )", f"{OPEN}n$1{CLOSE}")
    n = F.regexp_replace(n, rf"(?<= ){_PUNCT}*({_NUMBER}{_UNIT}){_PUNCT}*(?= )", f"{OPEN}q$1{CLOSE}")
    n = F.regexp_replace(n, rf"({OPEN}n[^{CLOSE}]*{CLOSE} ){_PUNCT}*({_UNIT}){_PUNCT}*(?= )", f"$1{OPEN}u$2{CLOSE}")
    df = df.withColumn("__t", F.when(t.rlike("[0-9]"), n).otherwise(t))
    # punctuation goes, except inside a slot's value
    return df.withColumn(out, F.lower(F.regexp_replace(t, rf"{_PUNCT}++(?![^ {OPEN}]*{CLOSE})", ""))).drop("__t")


def template(words: Column) -> Column:
    """Canonical words without the values of their slots."""
    return F.regexp_replace(words, f"{OPEN}(.)[^{CLOSE}]*{CLOSE}", f"{OPEN}$1")


def _split(canon: Column) -> Column:
    """Words of a canonical string."""
    inner = F.substring(canon, F.lit(2), F.greatest(F.length(canon) - 2, F.lit(0)))
    return F.when(F.length(canon) > 2, F.split(inner, " ")).otherwise(F.array().cast("array<string>"))


def _inner(canon: str) -> Column:
    return F.substring(F.col(canon), F.lit(2), F.greatest(F.length(canon) - 2, F.lit(0)))


def _shift(a: Column, k: int) -> Column:
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0)))


def window_hashes(df: DataFrame, word_hashes: str, k: int, out: str) -> DataFrame:
    """Adds the array of hashes of all runs of k words; each step is a column of its own, so it is computed once."""
    powers, have, n = {1: word_hashes}, 1, 1
    while have * 2 <= k:
        prev, have = powers[have], have * 2
        powers[have] = f"__w{have}"
        df = df.withColumn(powers[have], F.zip_with(F.col(prev), _shift(F.col(prev), have // 2), lambda a, b: F.xxhash64(a, b)))
    acc, n = powers[have], have
    while n < k:
        step = max(p for p in powers if p <= k - n)
        name = f"__a{n + step}"
        df = df.withColumn(name, F.zip_with(F.col(acc), _shift(F.col(powers[step]), n), lambda a, b: F.xxhash64(a, b)))
        acc, n = name, n + step
    fits = F.greatest(F.size(word_hashes) - (k - 1), F.lit(0))
    return df.withColumn(out, F.slice(F.col(acc), F.lit(1), fits))


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(f"__k{k}") for k in (1, 2)]


def _windows(df: DataFrame, keep: list[str], k: int, pos: str) -> DataFrame:
    hashed = df.withColumn("__h", F.transform(F.split(F.col("__template"), " "), lambda w: F.xxhash64(w)))
    # the outer form, as the inner one would add a filter that computes all windows a second time
    return (window_hashes(hashed, "__h", k, "__win").select(*keep, F.posexplode_outer("__win").alias(pos, "__hash"))
            .where("__hash is not null"))


def _prepared(df: DataFrame, text: str, keep: list) -> DataFrame:
    canon = with_canonical(df.select(*keep, F.col(text).alias("__text")), "__text", "__canon")
    return canon.withColumn("__template", template(_inner("__canon")))


def _join_windows(doc_side: DataFrame, bench_win: DataFrame, k: int) -> DataFrame:
    """Places where windows of k words meet, of documents with a ``__template`` and stored windows of the benchmark."""
    side = F.broadcast(bench_win) if bench_win.count() <= BROADCAST_WINDOWS else bench_win
    return (_windows(doc_side, ["__k1", "__k2"], k, "__i").join(side, "__hash")
            .select("__k1", "__k2", "__item", (F.col("__i") - F.col("__j")).alias("__diag"), "__j", F.lit(k).alias("__len")))


def _by_word(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, form, name: str) -> tuple[DataFrame, DataFrame]:
    """The places word by word (with __i, the document's word), and all words (__doc) of their documents in the given form."""
    places = stored(found.select("__k1", "__k2", "__item", "__diag",
                                 F.explode(F.sequence(F.col("__j"), F.col("__j") + F.col("__len") - 1)).alias("__j")).distinct(),
                    f"decontam-{name}places")
    hit_docs = stored(places.select("__k1", "__k2").distinct(), f"decontam-{name}docs")
    doc_words = (matching(docs.select(*_keys(id_col, text_col), F.col(text_col).alias("__text")), hit_docs)
                 .dropDuplicates(["__k1", "__k2"])
                 .transform(form, "__text", "__form")
                 .select("__k1", "__k2", F.posexplode(_split(F.col("__form"))).alias("__i", "__doc")))
    return places.withColumn("__i", (F.col("__diag") + F.col("__j")).cast("int")), doc_words


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS, min_fixed: int = MIN_FIXED,
            share: float = SHARE) -> DataFrame:
    """(__k1, __k2, item_id, covered): contaminated documents by key, with each item and its consistent words."""
    items = stored(bench.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("__text"))
                   .select("item_id", F.xxhash64(F.lit(1), "item_id", "__text").alias("__item"), "__text").dropDuplicates(["__item"])
                   .transform(with_canonical, "__text", "__canon").withColumn("__words", _split(F.col("__canon")))
                   .transform(with_exact, "__text", "__exact")
                   .select("item_id", "__item", "__canon", "__exact", "__words", F.size("__words").alias("n_words"))
                   .where("n_words > 0"), "decontam-items")
    item_words = items.select("item_id", "__item", "n_words", F.posexplode("__words").alias("__j", "__bench"))
    sizes = [r["k"] for r in items.select(F.least("n_words", F.lit(window)).alias("k")).distinct().collect()]  # at most `window` values
    prepared = _prepared(docs, text_col, _keys(id_col, text_col))
    verbatim = (docs.select(*_keys(id_col, text_col), F.col(text_col).alias("__text")).transform(with_exact, "__text", "__exact")
                .withColumn("__template", _inner("__exact")))
    fixed = F.size(F.filter(F.col("__part"), lambda w: ~F.startswith(w, F.lit(OPEN)) & (w != "")))
    written = F.exists(F.slice(_split(F.col("__exact")), F.col("__j") + 1, F.size("__part")), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    found = same = None
    for k in sorted(sizes):
        of_size = items.where((F.col("n_words") >= k) if k == window else (F.col("n_words") == k))

        def bench_windows(form: Column, of_size: DataFrame = of_size, k: int = k) -> DataFrame:
            return (_windows(of_size.withColumn("__template", form), ["__item", "__words", "__exact"], k, "__j")
                    .withColumn("__part", F.slice("__words", F.col("__j") + 1, F.lit(k))))

        bench_win = stored(bench_windows(template(_inner("__canon"))).where(fixed >= min(min_fixed, k))
                           .select("__item", "__j", "__hash"), f"decontam-windows-{k}")
        hits = _join_windows(prepared, bench_win, k)
        found = hits if found is None else found.unionByName(hits)
        # windows of too few ordinary words: the same words, slot values included
        exact_win = stored(bench_windows(_inner("__exact")).where((fixed < min(min_fixed, k)) & written)
                           .select("__item", "__j", "__hash"), f"decontam-exact-windows-{k}")
        if exact_win.count():
            hits = _join_windows(verbatim, exact_win, k)
            same = hits if same is None else same.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "__k1 long, __k2 long, item_id long, covered long")
    # places that matched, word by word
    place, doc_words = _by_word(found, docs, id_col, text_col, with_canonical, "")
    pairs = (place.join(doc_words, ["__k1", "__k2", "__i"])
             .join(item_words, ["__item", "__j"])
             .where(template(F.col("__doc")) == template(F.col("__bench"))))
    slot = F.startswith(F.col("__bench"), F.lit(OPEN))
    on = ["__k1", "__k2", "__item", "__diag"]
    kind = F.substring("__bench", 2, 1)
    bench_side = Window.partitionBy(*on, kind, "__bench")
    doc_side = Window.partitionBy(*on, kind, "__doc")
    slots = pairs.where(slot).select(*on, "item_id", "n_words", "__j",
                                     ((F.min("__doc").over(bench_side) == F.max("__doc").over(bench_side))
                                      & (F.min("__bench").over(doc_side) == F.max("__bench").over(doc_side))).alias("__ok"))
    good = (pairs.where(~slot).select(*on, "item_id", "n_words", "__j")
            .unionByName(slots.where("__ok").drop("__ok")))
    if same is not None:
        place, doc_words = _by_word(same, docs, id_col, text_col, with_exact, "exact-")
        exact_words = items.select("__item", "item_id", "n_words", F.posexplode(_split(F.col("__exact"))).alias("__j", "__bench"))
        good = good.unionByName(place.join(doc_words, ["__k1", "__k2", "__i"]).join(exact_words, ["__item", "__j"])
                                .where("__doc = __bench").select(*on, "item_id", "n_words", "__j"))
    return (good.select("__k1", "__k2", "__item", "item_id", "n_words", "__j").distinct()
            .groupBy("__k1", "__k2", "__item", "item_id", "n_words").agg(F.count("*").alias("covered"))
            .where(F.col("covered") >= F.when(F.col("n_words") < window, F.least(F.col("n_words"), F.lit(min_words)))
                   .when(F.col("n_words") <= min_words, F.ceil(F.col("n_words") * F.lit(share))).otherwise(F.lit(min_words)))
            .select("__k1", "__k2", "item_id", "covered"))


def matching(keyed: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Semi (or anti) join on __k1 and __k2; the keys are broadcast only when they are counted to be few."""
    named = keys.select(F.col("__k1").alias("__m1"), F.col("__k2").alias("__m2"))
    side = F.broadcast(named) if keys.count() <= BROADCAST_KEYS else named
    return keyed.join(side, (F.col("__k1") == F.col("__m1")) & (F.col("__k2") == F.col("__m2")), how)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, covered_words (the most of one item), first_item (least item id)."""
    per_doc = stored(matches(docs, bench, id_col, text_col, **options).groupBy("__k1", "__k2").agg(
        F.countDistinct("item_id").alias("n_items"), F.max("covered").alias("covered_words"),
        F.min("item_id").alias("first_item")), "decontam-found")
    named = per_doc.withColumnsRenamed({"__k1": "__m1", "__k2": "__m2"})
    side = F.broadcast(named) if per_doc.count() <= BROADCAST_KEYS else named
    keyed = docs.select(F.col(id_col).alias("doc_id"), *_keys(id_col, text_col))
    return (keyed.join(side, (F.col("__k1") == F.col("__m1")) & (F.col("__k2") == F.col("__m2")), "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    F.coalesce("covered_words", F.lit(0)).alias("covered_words"), "first_item"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that share no template of the benchmark, all columns unchanged."""
    found = stored(matches(docs, bench, id_col, text_col, **options).select("__k1", "__k2").distinct(), "decontam-found")
    # whole rows are one struct, so that their names cannot clash with those used here
    keyed = docs.select(F.struct("*").alias("__row"), *_keys(id_col, text_col))
    return matching(keyed, found, "left_anti").select("__row.*")
