"""Secret scans: fixed patterns, and a Markov test for strings that look random.

Everything on the main path is a DataFrame function. Spark's regular expressions give matches but not
their places; the places follow from the lengths of the pieces between the matches. The Markov models
are character bigram models, one of random strings and one of ordinary identifiers, trained from
labelled samples when the plan is built; a run of token characters is reported when its mean
log-likelihood ratio is above a threshold, and otherwise each stretch of it that is. Ratios are whole thousandths, so sums are exact everywhere.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import set_apart, table

# The patterns of the contract, as Java's regular expressions.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails as a whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6

#: Runs of these characters, this long at least, are tested by the models.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_RUN = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Thousandths of a nat for each pair of characters.
THRESHOLD = 800

# Words that ordinary identifiers are put together from.
IDENTIFIER_WORDS = (
    "the and that with from this have will your about which when there their would other into more only over such after first also "
    "new year some them these time state people world work life day part number system program question public order place right "
    "get set add remove update create delete find list map filter reduce count value index item node edge path file name type class "
    "method function return string integer buffer stream reader writer handler manager service client server request response message "
    "error warning result config option default version release build test check user account address customer product price total "
    "der die und das nicht eine sich auch werden haben les des que dans pour une est sur avec los las una por con para como entre"
).split()


def labelled_samples(seed: int = 7, n: int = 4000) -> list[tuple[str, int]]:
    """n strings of each label: 1 for random strings over usual alphabets, 0 for identifiers made of words."""
    rng = random.Random(seed)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = (digits + "abcdef", upper + "234567", lower + digits, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_")
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 48))), 1) for _ in range(n)]
    for _ in range(n):
        words = rng.choices(IDENTIFIER_WORDS, k=rng.randint(2, 6))
        form = rng.randrange(6)
        if form == 0:
            name = words[0] + "".join(w.capitalize() for w in words[1:])
        elif form == 1:
            name = "".join(w.capitalize() for w in words)
        elif form == 2:
            name = "_".join(words).upper()
        else:
            name = ("_", "-", "")[form - 3].join(words)
        out.append((name + (str(rng.randrange(100)) if rng.random() < 0.2 else ""), 0))
    return out


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.5) -> tuple[int, ...]:
    """The table of log ratios, random over ordinary, in thousandths: row by first character, column by second."""
    size, place = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[smoothing] * size for _ in range(size)] for _ in range(2)]
    for text, label in samples:
        for a, b in zip(text, text[1:], strict=False):
            if a in place and b in place:
                counts[label][place[a]][place[b]] += 1
    logs = [[[math.log(x / sum(row)) for x in row] for row in counts[label]] for label in range(2)]
    return tuple(round(1000 * (r - o)) for random_row, usual_row in zip(logs[1], logs[0], strict=True) for r, o in zip(random_row, usual_row, strict=True))


@cache
def default_table() -> tuple[int, ...]:
    return train(labelled_samples())


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row."""
    return F.transform(F.array(value), then)[0]


def places(text: Column, pattern: str, kind: int, more: Column | None = None) -> Column:
    """The matches as structs (start, kind, end, text, extra); `more` is an array of the matches' extras."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    extra = more if more is not None else F.transform(matches, lambda _: F.lit(None).cast("string"))
    zipped = F.zip_with(F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap"))), extra, lambda x, e: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), e.alias("e")))
    kept = F.filter(zipped, lambda x: x["m"].isNotNull())
    first = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("text"), x["e"].alias("extra"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    return F.aggregate(kept, first, step, lambda s: s["out"])


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,text:string,extra:string>>")


def pair_ratios(token: Column, scores: Column) -> Column:
    size = len(ALPHABET)
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(ids, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: scores[a * size + b]))


def total(ratios: Column) -> Column:
    return F.aggregate(ratios, F.lit(0).cast("long"), lambda s, v: s + v)


def stretches(ratios: Column, threshold: int) -> Column:
    """The random stretches of a run, given its pairs' ratios: structs (first, last) of characters.

    They are disjoint, of LEAST_RUN characters at least, and between them no stretch of that length has a mean
    over the threshold. One pass over the sums of what the pairs have above it: a stretch opens as soon as some start
    at least LEAST_RUN characters back has a smaller sum, grows while sums rise above its end's, and is
    closed by the next that opens after its end. It begins at the least sum before it opened.
    """
    back = LEAST_RUN - 1
    none = F.lit(-1)
    zero = F.lit(0).cast("long")
    state = ("sum", "past", "low", "low_at", "least", "least_at", "first", "last", "top", "opened")
    named = lambda out, **now: F.struct(*[now[n].alias(n) for n in state], out.alias("out"))
    begin = named(F.array().cast("array<struct<first:int,last:int>>"), sum=zero, past=zero, low=zero, low_at=none, least=zero, least_at=none, first=none, last=none, top=zero, opened=none)
    done = lambda s: F.when(s["first"] >= 0, F.array_append(s["out"], F.struct(s["first"].alias("first"), s["last"].alias("last")))).otherwise(s["out"])

    def step(s: Column, j: Column) -> Column:
        at = j - back
        past = s["past"] + F.when(at >= 1, F.get(ratios, at - 1) - threshold).otherwise(0)
        sums = F.struct(*[s[n].alias(n) for n in (*state[2:], "out")], (s["sum"] + F.get(ratios, j - 1) - threshold).alias("sum"), past.alias("past"), at.alias("at"))
        return let(sums, lambda v: let(lowered(v), lambda w: grown(w, j)))

    def lowered(v: Column) -> Column:
        lower = (v["at"] >= 0) & (v["at"] > v["last"]) & ((v["low_at"] < 0) | (v["past"] < v["low"]))
        earlier = (v["first"] >= 0) & (v["at"] <= v["opened"]) & (v["past"] < v["least"])
        pick = lambda c, n, x: F.when(c, v[x]).otherwise(v[n])
        return named(
            v["out"], sum=v["sum"], past=v["past"], first=v["first"], last=v["last"], top=v["top"], opened=v["opened"],
            low=pick(lower, "low", "past"), low_at=pick(lower, "low_at", "at"), least=pick(earlier, "least", "past"), least_at=pick(earlier, "least_at", "at"),
        )

    def grown(w: Column, j: Column) -> Column:
        same = {n: w[n] for n in state}
        longer = named(w["out"], **same | {"first": w["least_at"], "last": j, "top": w["sum"], "low_at": none})
        fresh = named(done(w), **same | {"first": w["low_at"], "last": j, "top": w["sum"], "opened": j, "least": w["low"], "least_at": w["low_at"], "low_at": none})
        return F.when((w["first"] >= 0) & (w["sum"] > w["top"]), longer).when((w["low_at"] >= 0) & (w["sum"] > w["low"]), fresh).otherwise(w)

    return F.aggregate(F.sequence(F.lit(1), F.size(ratios)), begin, step, done)


def base_spans(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assigned = F.filter(places(text, ASSIGN, 0, values), lambda s: F.length(s["extra"]) >= LEAST_VALUE)
    parts = [(ASSIGN, assigned), (ACCESS, places(text, ACCESS, 1)), (HEX, places(text, HEX, 2))]
    return F.concat(*[F.when(text.rlike(p), x).otherwise(no_spans()) for p, x in parts])


def markov_spans(text: Column, base: Column, scores: Column, threshold: int = THRESHOLD) -> Column:
    """Runs that the models call random, and the random stretches of other runs; none of them inside a base span.

    A stretch is reported up to the next of '/', '=', '_' and '-' on either side, as its outermost pairs may look ordinary.
    """
    reach = lambda after: F.length(F.regexp_extract(after, "^[A-Za-z0-9+]*", 0))

    def random_parts(run: Column, ratios: Column) -> Column:
        ends = lambda x: F.struct((x["first"] - reach(F.reverse(F.substring(run["text"], F.lit(1), x["first"])))).alias("first"), (x["last"] + 1 + reach(F.substring(run["text"], x["last"] + 2, F.length(run["text"])))).alias("end"))
        part = lambda x: let(ends(x), lambda y: F.struct(
            (run["start"] + y["first"]).alias("start"), run["kind"].alias("kind"), (run["start"] + y["end"]).alias("end"),
            F.substring(run["text"], y["first"] + 1, y["end"] - y["first"]).alias("text"), run["extra"].alias("extra"),
        ))
        return F.when(total(ratios) > F.size(ratios) * threshold, F.array(run)).otherwise(F.transform(stretches(ratios, threshold), part))

    free = lambda spans: F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    found = F.flatten(F.transform(free(places(text, TOKEN, 3)), lambda run: let(pair_ratios(run["text"], scores), lambda r: random_parts(run, r))))
    return F.when(text.rlike(TOKEN), free(found)).otherwise(no_spans())


def score_table(scores: tuple[int, ...]) -> Column:
    return F.split(F.lit(",".join(map(str, scores))), ",").cast("array<int>")


def scan(df: DataFrame, text: str = "text", scores: tuple[int, ...] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Adds `base` and `found`, arrays of spans in order; `found` holds the base spans too.

    A null text counts as empty and has no spans; texts are scanned whole, however long. Spans are in code points, the end
    exclusive; those that begin alike come in the order of their kinds. Rows are scanned one by one, so repeated rows get
    equal spans. Columns may have any names; those named base or found are replaced. An empty table stays empty.
    """
    flat, at, back = set_apart(df)
    body = F.coalesce(F.col(at[text]), F.lit(""))
    out = flat.withColumn("base", F.array_sort(base_spans(body)))
    table_ = score_table(scores or default_table())
    return back(out, {"base": F.col("base"), "found": F.array_sort(F.concat("base", markov_spans(body, F.col("base"), table_, threshold)))})


def rendered(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mark; overlapping spans share one mark."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] < state["at"], state["out"]).otherwise(fresh).alias("out"))

    return F.aggregate(spans, first, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their secrets masked; a text without any, or null, is left as it is."""
    names = df.columns
    out = scan(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), f"c{names.index(text)}")
    body = F.col(f"c{names.index(text)}")
    masked = F.when(F.size("found") > 0, redacted(body, F.col("found"))).otherwise(body)
    return out.select(*[(masked if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned in full; the base digest and counts, and every span in order."""
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.encode(rendered(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        rendered(F.col("found")).alias("spans"),
    )
