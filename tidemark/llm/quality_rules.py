"""Quality rules: fixed limits, then robust multivariate outliers for each language and source.

Statistics of every whole text are transformed to a vector.  For each language and source a minimum covariance
determinant estimate is sought from several starts by concentration steps, each of which takes the location and
scatter of the closest share of rows; the start of least determinant goes on to its minimum.  The estimate of a group
leans on that of its language, which leans on that of all rows, the less so the more rows it has.  A row goes when
its Mahalanobis distance is too large.
Only DataFrame expressions: text is read once, the steps run on a table of a few numbers for each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut, let, salt_of

#: Limits of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Share of a group's rows that an estimate rests on.
SHARE = 0.6
#: Starts from single rows, and how often all starts are concentrated before one is chosen.
DRAWN, FIRST = 2, 2
#: The chosen one is concentrated until the log of no determinant falls by more than this; never more often than so.
TOLERANCE, MOST_STEPS = 1e-3, 30
#: Rows that the estimate of a language counts as beside those of a group, and that of all rows beside a language's.
LEAN = 60.0
#: The vector, and for each part a standard deviation that always counts as ordinary.
VECTOR = {"word_length": 0.05, "symbols": 0.15, "dup_lines": 0.15, "repeats": 0.15, "capitals": 0.10, "marks": 0.15}
#: Squared distance beyond which a row goes: six dimensions pass it by chance once in 2e10 rows.
LIMIT = 60.0
#: The median of chi-square with six degrees of freedom.
CHI_MEDIAN = 5.348
#: Groups up to which their estimates are broadcast; with more, rows meet them by a salted shuffle.
BROADCAST_GROUPS, SALTS = 50_000, 32

BLANKS = r"\x20\x09-\x0D"
_D = len(VECTOR)
_PAIRS = [(i, k) for i in range(_D) for k in range(i + 1)]


def _count(text: Column, others: str) -> Column:
    """How many characters are left without runs of others (a character class)."""
    return F.char_length(F.regexp_replace(text, f"[{others}]+", "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    A window is packed into one number, the hash above and its position below, so that equal windows are
    neighbours once sorted; neighbours are then compared word by word.
    """

    def count(ws: Column) -> Column:
        n = F.size(ws)

        def found(bits: Column) -> Column:
            packed = F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.call_function("shiftleft", F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)), bits) + i,
            )

            def covered(p: Column) -> Column:
                def at(x: Column) -> Column:
                    return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

                def same(x: Column, y: Column) -> Column:
                    equal = F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0
                    return F.coalesce(equal & (F.get(ws, at(x)) == F.get(ws, at(y))) & (F.get(ws, at(x) + 1) == F.get(ws, at(y) + 1)) & (F.get(ws, at(x) + 2) == F.get(ws, at(y) + 2)), F.lit(False))

                twice = F.filter(p, lambda x, k: same(x, F.get(p, k + 1)) | same(x, F.get(p, k - 1)))
                places = F.sort_array(F.transform(twice, at))
                start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
                return F.aggregate(places, start, lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(3), x - a["last"])).alias("total")), lambda a: a["total"])

            return let(F.sort_array(packed), covered)

        return F.when(n < 4, F.lit(0)).otherwise(let(F.length(F.bin(n)), found)).cast("long")

    return let(words, count)


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source and the statistics of each text; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), *carry)
    words = F.filter(F.split("text", f"[{BLANKS}]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return base.select(
        "doc_id",
        "lang",
        "source",
        *carry,
        let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        _count(F.col("text"), BLANKS).alias("word_chars"),
        _count(F.col("text"), "^#*$%&|<>").alias("n_symbols"),
        _count(F.col("text"), "^A-Z").alias("n_capitals"),
        _count(F.col("text"), "^!?.,;:").alias("n_marks"),
    ).select(
        "doc_id", "lang", "source", *carry, F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.n_repeat_words").alias("n_repeat_words"), "n_capitals", "n_marks", F.col("l.n").alias("n_lines")
    )


def vector() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    parts = [
        F.log(chars / words),
        F.log1p(F.col("n_symbols") * 10 / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
        F.log1p(F.col("n_capitals") * 10 / chars),
        F.log1p(F.col("n_marks") * 10 / words),
    ]
    return [p.cast("double").alias(f"x{i}") for i, p in enumerate(parts)]


def _square(value: Callable[[Column, Column], Column]) -> Column:
    """A matrix by rows, as an array, of value(row, column)."""
    return F.transform(F.sequence(F.lit(0), F.lit(_D * _D - 1)), lambda t: value(F.floor(t / _D).cast("int"), t % _D))


def _swept() -> Column:
    """The scatter c with each row swept in turn: a, whose negative is its inverse, and logdet, the log of its
    determinant."""

    def sweep(now: Column, k: Column) -> Column:
        a = now["a"]

        def at(i: Column, j: Column) -> Column:
            return F.get(a, i * _D + j)

        def swept(pivot: Column) -> Column:
            def value(i: Column, j: Column) -> Column:
                both = at(i, j) - at(i, k) * at(k, j) / pivot
                return F.when((i == k) & (j == k), -1 / pivot).when((i == k) | (j == k), at(i, j) / pivot).otherwise(both)

            return F.struct(_square(value).alias("a"), (now["logdet"] + F.log(pivot)).alias("logdet"))

        return let(F.greatest(at(k, k), F.lit(1e-12)), swept)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(_D - 1)), F.struct(F.col("c").alias("a"), F.lit(0.0).alias("logdet")), sweep)
    return let(done, lambda d: d)


def _inverted(est: DataFrame, swept: Column | None = None) -> DataFrame:
    """Adds p, the inverse of the scatter c, and logdet, the log of its determinant; swept: _swept() where it is at
    hand."""
    out = est.withColumn("done", _swept() if swept is None else swept).withColumn("p", F.transform("done.a", lambda x: -x))
    return out.withColumn("logdet", F.col("done.logdet")).drop("done")


def _distance() -> Column:
    """The squared Mahalanobis distance of a row's x from m by p."""

    def of(d: list[Column]) -> Column:
        return sum((d[i] * d[k] * F.get("p", F.lit(i * _D + k)) * (1 if i == k else 2) for i, k in _PAIRS), F.lit(0.0))

    return of([F.col(f"x{i}") - F.get("m", F.lit(i)) for i in range(_D)])


def _meet(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their estimates, by level and key; few: there are few of these, to be broadcast."""
    if few:
        return rows.join(F.broadcast(estimates), ["level", "key"])
    dealt = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt_of("doc_id", SALTS)).join(dealt, ["level", "key", "salt"]).drop("salt")


def _matrix(name: Callable[[int, int], Column]) -> Column:
    """A symmetric matrix of the columns that name gives for its lower half."""
    return F.array(*(name(max(i, k), min(i, k)) for i in range(_D) for k in range(_D)))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Estimates to begin with, for each level, key and start: medians with deviations; with the correlation of
    directions from there; with that of values bent towards the middle; and single rows, drawn by hashes."""
    middle = F.array(*(F.percentile_approx(f"x{i}", 0.5, 1000) for i in range(_D)))
    medians = cut(rows.groupBy("level", "key").agg(F.count("*").alias("n"), middle.alias("m")))
    off = [F.abs(F.col(f"x{i}") - F.get("m", F.lit(i))) for i in range(_D)]
    spread = F.array(*(F.greatest(F.percentile_approx(d, 0.5, 1000) * 1.4826, F.lit(floor)) for d, floor in zip(off, VECTOR.values())))
    middle = cut(medians.join(_meet(rows, medians, few).groupBy("level", "key").agg(spread.alias("s")), ["level", "key"]))
    xs = [f"x{i}" for i in range(_D)]
    scaled = _meet(rows, middle, few).withColumns({f"z{i}": (F.col(x) - F.get("m", F.lit(i))) / F.get("s", F.lit(i)) for i, x in enumerate(xs)})
    scaled = scaled.withColumn("length", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(_D)), F.lit(1e-9)))
    told = scaled.groupBy("level", "key").agg(
        _matrix(lambda i, k: F.avg(F.col(f"z{i}") * F.col(f"z{k}") / F.col("length"))).alias("turns"),
        _matrix(lambda i, k: F.avg(F.tanh(f"z{i}") * F.tanh(f"z{k}"))).alias("bends"),
        F.array(*(F.min_by(F.array(*xs), F.xxhash64(F.lit(d), *xs)) for d in range(DRAWN))).alias("drawn"),
    )
    told = cut(middle.join(told, ["level", "key"]))

    def scatter(r: Column | None) -> Column:
        def value(i: Column, k: Column) -> Column:
            if r is None:
                return F.when(i == k, F.get("s", i) * F.get("s", k)).otherwise(F.lit(0.0))
            size = F.sqrt(F.greatest(F.get(r, i * _D + i) * F.get(r, k * _D + k), F.lit(1e-12)))
            return F.get("s", i) * F.get("s", k) * F.when(i == k, F.lit(1.0)).otherwise(0.95 * F.get(r, i * _D + k) / size)

        return _square(value)

    plain = [F.struct(F.col("m").alias("m"), scatter(r).alias("c")) for r in (None, F.col("turns"), F.col("bends"))]
    single = [F.struct(F.get("drawn", F.lit(d)).alias("m"), scatter(None).alias("c")) for d in range(DRAWN)]
    return told.select("level", "key", "n", F.posexplode(F.array(*plain, *single)).alias("start", "e")).select("level", "key", "start", "n", "e.m", "e.c")


def _step() -> dict[str, Column]:
    """The columns of a concentration step, which are the same in all steps: the driver builds each by hundreds of
    calls, so that they are built once."""
    floor = F.array(*(F.lit(x * x) for x in VECTOR.values()))
    return {
        "distance": _distance(),
        "mean": F.array(*(F.avg(f"x{i}") for i in range(_D))).alias("m"),
        "products": _matrix(lambda i, k: F.avg(F.col(f"x{i}") * F.col(f"x{k}"))).alias("q"),
        "scatter": _square(lambda i, k: F.get("q", i * _D + k) - F.get("m", i) * F.get("m", k) + F.when(i == k, F.get(floor, i)).otherwise(0.0)).alias("c"),
        "swept": _swept(),
    }


def _concentrate(rows: DataFrame, now: DataFrame, few: bool, step: dict[str, Column]) -> DataFrame:
    """The estimates from the closest share of rows of each estimate of now."""
    by = ["level", "key", "start"]
    apart = _meet(rows, now.select(*by, "m", "p"), few).withColumn("d", step["distance"])
    far = apart.groupBy(*by).agg(F.percentile_approx("d", SHARE, 10_000).alias("far"))
    near = _meet(rows, now.select(*by, "n", "m", "p").join(far, by), few).where(step["distance"] <= F.col("far"))
    sums = near.groupBy(*by).agg(F.first("n").alias("n"), step["mean"], step["products"])
    return cut(_inverted(sums.select(*by, "n", "m", step["scatter"]), step["swept"]))


def estimates(rows: DataFrame, few: bool = True) -> DataFrame:
    """Location m, scatter c, its inverse p, logdet and scale of the minimum covariance determinant estimate of each
    level and key of rows(doc_id, level, key, x0, ...).

    All starts are concentrated FIRST times; the one of least determinant goes on until no group's determinant falls
    any more.  few: there are few groups.
    """
    by = ["level", "key"]
    step = _step()
    now = cut(_inverted(_starts(rows, few), step["swept"]))
    for _ in range(FIRST):
        now = _concentrate(rows, now, few, step)
    best = cut(now.groupBy(*by).agg(F.min_by(F.struct(*(c for c in now.columns if c not in by)), F.struct("logdet", "start")).alias("e")).select(*by, "e.*"))
    for _ in range(MOST_STEPS):
        then = _concentrate(rows, best, few, step)
        before = best.select(*by, F.col("logdet").alias("before"))
        fell = then.join(before, by).agg(F.max(F.col("before") - F.col("logdet")).alias("d")).first()["d"]
        best = then
        if fell is None or fell < TOLERANCE:
            break
    scale = _meet(rows, best, few).groupBy(*by).agg(F.greatest(F.percentile_approx(step["distance"], 0.5, 10_000) / CHI_MEDIAN, F.lit(1.0)).alias("scale"))
    return best.join(scale, by).drop("start")


def _lean(est: DataFrame, m: Column, c: Column, scale: Column) -> DataFrame:
    """est drawn towards the estimate m, c, scale as if that were LEAN rows more: the mixture's location and scatter."""
    w = F.col("n") / (F.col("n") + LEAN)
    apart = F.transform("m", lambda x, i: x - F.get(m, i))
    scatter = _square(lambda i, k: w * F.get("c", i * _D + k) + (1 - w) * F.get(c, i * _D + k) + w * (1 - w) * F.get(apart, i) * F.get(apart, k))
    return est.select(*(x for x in est.columns if x not in ("m", "c", "scale")), F.transform("m", lambda x, i: w * x + (1 - w) * F.get(m, i)).alias("m"), scatter.alias("c"), (w * F.col("scale") + (1 - w) * scale).alias("scale"))


def apply_rules(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance.

    Null or empty texts have no words and fail the base rules.  A null language or source is a group of its own.
    distance is null where the base rules decide.  Repeated rows are judged alike.  Columns named in carry are passed
    on, others ignored.
    """
    stats = cut(statistics(docs, carry))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    keys = [F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang")), F.lit("{}")]
    good = cut(stats.where("not base_failed").select("doc_id", "lang", "source", *vector()))
    rows = good.select("doc_id", *(f"x{i}" for i in range(_D)), F.posexplode(F.array(*keys)).alias("level", "key"))
    own = cut(good.select(keys[0].alias("key"), keys[1].alias("lang_key")).distinct())
    few = bounded(own, BROADCAST_GROUPS)
    found = cut(estimates(rows, few))
    whole = found.where("level = 2").select("m", "c", "scale").first()  # one row; none where nothing passes
    whole = [F.array(*map(F.lit, whole["m"])), F.array(*map(F.lit, whole["c"])), F.lit(whole["scale"])] if whole else [F.col("m"), F.col("c"), F.col("scale")]
    langs = _lean(found.where("level = 1").select("key", "n", "m", "c", "scale"), *whole)
    langs = cut(langs.select(F.col("key").alias("lang_key"), F.col("m").alias("m1"), F.col("c").alias("c1"), F.col("scale").alias("scale1")))
    groups = found.where("level = 0").select("key", "n", "m", "c", "scale").join(own, "key").join(langs, "lang_key")
    groups = _inverted(_lean(groups, F.col("m1"), F.col("c1"), F.col("scale1")))
    choice = cut(groups.select(F.lit(0).alias("level"), "key", "m", "p", "scale"))
    every = stats.select("*", F.lit(0).alias("level"), keys[0].alias("key")).withColumns({f"x{i}": c for i, c in enumerate(vector())})
    passed = _meet(every.where("not base_failed"), choice, few).withColumn("distance", _distance() / F.col("scale"))
    columns = ["doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rest = stats.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.select(*columns, (F.col("distance") <= LIMIT).alias("kept"), "distance").unionByName(rest)
