"""Quality rules: counts of a text, and its divergence from language references.

Everything on the main path is a DataFrame function. A text's words become an array once; repeated
three-word windows are found by sorting the windows' 64-bit hashes with their places. The histograms
of character classes and common words of all documents are summed by language into references, and
a document is held against its own language's by the Jensen-Shannon distance. Short texts, whose
histograms say little, pass that test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import SPACES, cut, table, text_or_empty
from strataflow.llm.secrets import let

# Common words of four languages.
COMMON_WORDS = (
    "the of and to in a is that "
    "der die und das ist nicht von für "
    "le les et des que pour est une "
    "el los y las por con para del"
).split()
#: Each common word has a character of its own; texts of them are counted by character.
MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "wide", "other")
SYMBOLS = r"[#*$%&|<>]"
#: Up to so many repeated windows, membership is tested in a list; beyond, all windows are sorted with their places.
LISTED = 48

#: Texts with fewer words, or fewer common words for the word histogram, aren't held against a reference.
LEAST_WORDS = 50
LEAST_COMMON = 20
#: Distances from 0 to 1 beyond which a text fails.
MOST_CLASSES = 0.31
MOST_COMMON = 0.60


def words_of(text: Column) -> Column:
    """The words in order; none for a text of white space only."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """The number of words inside three-word windows that are found twice or more."""

    def covered(at: Column) -> Column:
        """Words covered by windows that start at the sorted places `at`."""
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, v: s + v))

    def from_list(h: Column, twice: Column) -> Column:
        return covered(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda p: p.isNotNull()))

    def from_sort(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        near = lambda s, k: F.coalesce(F.get(s, k)["h"], F.lit(None))
        hits = let(ranked, lambda s: F.transform(s, lambda x, k: F.when((x["h"] == near(s, k + 1)) | (x["h"] == near(s, k - 1)), x["i"])))
        return covered(F.sort_array(F.filter(hits, lambda p: p.isNotNull())))

    def counted(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(F.transform(s, lambda x, k: F.when(x == F.get(s, k + 1), x)), lambda x: x.isNotNull())))
        return let(again, lambda d: F.when(F.size(d) == 0, 0).when(F.size(d) <= LISTED, from_list(h, d)).otherwise(from_sort(h)))

    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, let(windows, counted)).otherwise(0).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.when(F.instr(text, "\n") > 0, let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long")


def common_marks(words: Column) -> Column:
    """One character for each common word of the text, in order."""
    listed = F.array(*map(F.lit, COMMON_WORDS))
    found = F.transform(F.filter(words, lambda w: F.length(w) <= max(map(len, COMMON_WORDS))), lambda w: F.array_position(listed, F.lower(w)).cast("int"))
    return F.array_join(F.transform(found, lambda k: F.substring(F.lit(MARKS), k, F.when(k > 0, 1).otherwise(0))), "")


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep`, the counts of the contract, `classes` and `common`: histograms as arrays of long."""
    body = text_or_empty(text)
    df = df.select(*keep, body.alias("__text"), words_of(body).alias("__words"))
    df = df.select(
        *keep,
        F.length("__text").alias("__n"),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(without(F.col("__text"), SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("__text")).alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        *[(F.length("__text") - F.length(without(F.col("__text"), p))).alias(f"__{c}") for c, p in (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("wide", r"[^\x00-\x7F]+"))],
        common_marks(F.col("__words")).alias("__marks"),
    )
    df = df.withColumns({"__space": F.col("__n") - F.col("word_chars"), "__symbol": F.col("n_symbols")})
    df = df.withColumn("__other", F.col("__n") - sum((F.col(f"__{c}") for c in CLASSES[:-1]), F.lit(0)))
    common = [F.length("__marks") - F.length(F.replace("__marks", F.lit(m))) for m in MARKS]
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*[F.col(f"__{c}").cast("long") for c in CLASSES]).alias("classes"),
        F.array(*[c.cast("long") for c in common]).alias("common"),
    )


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance, 0 to 1, of two histograms of the same bins; 0 if either is empty."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, v: s + v)
    share = lambda h: let(total(h), lambda t: F.transform(h, lambda v: v / t))
    terms = F.zip_with(share(p), share(q), lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms)))).otherwise(0.0)


def references(stats: DataFrame, lang: str) -> DataFrame:
    """One row a language: the summed histograms of all its documents. Null is a language."""
    bins = [(h, i) for h, n in (("classes", len(CLASSES)), ("common", len(COMMON_WORDS))) for i in range(n)]
    summed = stats.groupBy(F.col(lang).alias("__lang")).agg(*[F.sum(F.col(h)[i]).alias(f"__{h}{i}") for h, i in bins])
    return summed.select("__lang", *[F.array(*[F.col(f"__{h}{i}") for g, i in bins if g == h]).alias(f"__ref_{h}") for h in ("classes", "common")])


def judge(df: DataFrame, text: str, lang: str, keep: list[str]) -> DataFrame:
    """`keep` and the counts, base_failed, class_distance, common_distance and kept, one row a document.

    Null text: no words, so base_failed. A null language is a group with a reference of its own.
    """
    stats = cut(counts(df, text, list(dict.fromkeys([*keep, lang]))), "quality")
    held = stats.join(references(stats, lang), F.col(lang).eqNullSafe(F.col("__lang")), "left")
    common_words = reduce(lambda a, b: a + b, [F.col("common")[i] for i in range(len(COMMON_WORDS))])
    held = held.withColumns({
        "class_distance": F.when(F.col("n_words") >= LEAST_WORDS, divergence(F.col("classes"), F.col("__ref_classes"))).otherwise(0.0),
        "common_distance": F.when(common_words >= LEAST_COMMON, divergence(F.col("common"), F.col("__ref_common"))).otherwise(0.0),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    kept = ~F.col("base_failed") & (F.col("class_distance") <= MOST_CLASSES) & (F.col("common_distance") <= MOST_COMMON)
    return held.withColumn("kept", kept).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "kept"
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged, whole texts; references come from all documents of a language."""
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "lang", ["doc_id"])
    return found.drop("class_distance", "common_distance")
