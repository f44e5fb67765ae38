"""Secret scans: base patterns and a battery of randomness tests, in DataFrame functions only.

Base spans are matches of three patterns.  Beyond them, every run of twenty or more
letters, digits and ``+/_=-`` is tested against the hypothesis that it is drawn
uniformly from the alphabet it is written in (hexadecimal, base32 or base64):

* chi-squared uniformity of the characters,
* a runs test of the upper and lower half of the alphabet,
* the serial correlation of neighbouring characters.

The smallest p-value, times three, is the p-value of the run.  Within each alphabet and
length band the runs are ordinary text as far as a false-discovery rate of ``RATE``
allows: at most that share of those set aside is random by expectation, for short
runs and long ones alike.  What is not set aside is a secret of kind ``random``.  In the
shortest band, where the battery says little, that needs a threshold from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiflux.llm.common import fresh
from epiflux.session import stored

# The base patterns and the fewest characters they ask for.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
# End of the fixed values.

KINDS = ("assign", "access", "hex", "random")
#: Alphabets by name, in the order in which a run is matched to them.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Upper ends of the length bands, by powers of two from the first.
BANDS = (24, 32, 48, 64, 128, 256)
#: First band whose length lets the battery tell text from random characters by itself.
TELLING_BAND = 1
#: Share of random runs among those set aside as text, by expectation.
RATE = 0.01
#: Least value of a run: below it even a fair random run counts as text.
_LOG_P = 12.0
_STEP = 4  # bins of the p-values per power of ten

_SPANS, _RUNS = "array<struct<start:int,end:int>>", "array<struct<start:int,end:int,run:string>>"
#: Matches that are added up at once.
_CHUNK = 256
#: Stands for the characters of base spans where runs are looked for; a text's own marks become
#: another character that is part of no pattern.
_MARK, _NO_MARK = "\ue000", "\ue001"


def _steps(text: Column, pattern: str, value_group: int = 0) -> Column:
    """``gap, hit`` of the matches in order, and of the rest of the text, where ``hit`` is NULL.

    With ``value_group`` also that group, as ``value``.
    """
    hits = {"hit": 0, "value": value_group} if value_group else {"hit": 0}
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), *[
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias(name) for name, group in hits.items()])


def _good(step: Column, at_least: int) -> Column:
    """Whether a step ends in a match, with ``at_least`` in one whose value is so long."""
    return F.length(step["value"]) >= at_least if at_least else step["hit"].isNotNull()


def _chunks(values: Column) -> Column:
    """A filled array in parts of ``_CHUNK``."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int"))
    return F.transform(numbers, lambda i: F.slice(values, i * _CHUNK + 1, F.lit(_CHUNK)))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, at_least: int = 0, with_hit: bool = False) -> Column:
    """Spans, in code points, of all matches; with ``at_least``, of those whose group 2 is so long.

    ``with_hit`` adds what matched, as ``run``.

    The matches are added up in chunks, since an array that grows by one is copied each
    time: the work for n matches is about n times the chunk, not n times n.
    """
    kind = _RUNS if with_hit else _SPANS

    def add(state, step):
        start = state["at"] + F.length(step["gap"])
        end = start + F.coalesce(F.length(step["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), *([step["hit"].alias("run")] if with_hit else []))
        out = F.when(_good(step, at_least), F.concat(state["out"], F.array(span).cast(kind))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def add_chunk(state, chunk):
        zero = F.struct(state["at"].alias("at"), F.array().cast(kind).alias("out"))
        return _bound(F.aggregate(chunk, zero, add), lambda done: F.struct(
            done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

    def spans(steps):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(_chunks(steps), zero, add_chunk, lambda state: F.flatten(state["out"]))

    found = _bound(_steps(text, pattern, 2 if at_least else 0), spans)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def _marked(text: Column, pattern: str, at_least: int = 0) -> Column:
    """The text with ``_MARK`` for every character of the matches that ``_matches`` finds."""
    parts = F.transform(_steps(text, pattern, 2 if at_least else 0), lambda step: F.concat(step["gap"], F.coalesce(
        F.when(_good(step, at_least), F.repeat(F.lit(_MARK), F.length(step["hit"]))), step["hit"], F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def _upper_tail(z: Column) -> Column:
    """Share of the normal distribution above ``z``."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _battery(run: Column, alphabet: str) -> Column:
    """-log10 of the p-value of a run of the alphabet; other characters count as none."""
    k, length = len(alphabet), F.length(run)
    counts = F.transform(
        F.array(*[F.lit(c) for c in alphabet]), lambda c: length - F.length(F.replace(run, c, F.lit("")))
    )
    squares = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n.cast("double") * n)
    chi = F.greatest(F.lit(0.0), squares * k / length - length)
    df = k - 1
    p_chi = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)

    half = F.translate(run, alphabet, "0" * (k // 2) + "1" * (k // 2))
    ones = F.length(F.replace(half, F.lit("0"), F.lit("")))
    zeros = length - ones
    turns = (2 * length - F.length(F.replace(half, F.lit("01"), F.lit("")))
             - F.length(F.replace(half, F.lit("10"), F.lit("")))) / 2
    both = 2.0 * ones * zeros
    spread = F.sqrt(both * (both - length) / (length * length * (length - 1.0)))
    p_runs = F.when(
        (ones > 0) & (zeros > 0) & (spread > 0), 2 * _upper_tail(F.abs(turns - both / length) / spread)
    ).otherwise(F.pow(F.lit(0.5), (length - 1).cast("double")))

    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    mean = F.aggregate(places, F.lit(0.0), lambda s, x: s + x) / length
    variance = F.aggregate(places, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    products = F.zip_with(
        F.slice(places, F.lit(1), length - 1), F.slice(places, F.lit(2), length - 1),
        lambda a, b: (a - mean) * (b - mean),
    )
    serial = F.aggregate(products, F.lit(0.0), lambda s, x: s + x) / variance
    p_serial = F.when(variance > 0, 2 * _upper_tail(F.abs(serial) * F.sqrt(length.cast("double")))).otherwise(0.0)

    p = F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))
    return F.when(p > 10**-_LOG_P, -F.log10(p)).otherwise(F.lit(_LOG_P))


def _tested(text: Column) -> Column:
    """``start, end, alphabet, band, value`` of the runs outside the base spans; bare numbers are no runs.

    Characters of base spans are marked and the marks are part of a run, so a run that a
    base span touches holds a mark.  Spans begin with characters of a run, and what follows
    one is none or makes it longer, so no run is lost that only stands beside a span.
    """
    marked = F.translate(text, _MARK, _NO_MARK)
    for pattern, at_least in ((ASSIGN, ASSIGN_CHARS), (ACCESS, 0), (HEX, 0)):
        marked = _bound(marked, lambda body: _marked(body, pattern, at_least))
    return _bound(marked, _runs)


def _runs(marked: Column) -> Column:
    runs = _matches(marked, CANDIDATE.replace("[", f"[{_MARK}"), with_hit=True)
    mixed = F.filter(runs, lambda s: ~s["run"].contains(_MARK) & s["run"].rlike("[0-9]") & s["run"].rlike("[A-Za-z]"))

    def judged(s):
        run = s["run"]
        lower, plain = F.lower(run), F.translate(run, "-_=", "+/")
        name = F.when(lower.rlike("^[0-9a-f]+$") & ((run == lower) | (run == F.upper(run))), "hex").when(
            run.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")
        value = F.when(name == "hex", _battery(lower, ALPHABETS["hex"])).when(
            name == "base32", _battery(F.replace(run, F.lit("="), F.lit("")), ALPHABETS["base32"])
        ).otherwise(_battery(plain, ALPHABETS["base64"]))
        band = sum(F.when(F.length(run) > end, 1).otherwise(0) for end in BANDS)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), name.alias("alphabet"), band.alias("band"),
            F.floor(value * _STEP).cast("int").alias("value"),
        )

    return F.transform(mixed, judged)


def thresholds(runs: DataFrame) -> DataFrame:
    """``alphabet, band, cut``: runs of a value of ``cut`` or more are text (Benjamini and Hochberg).

    ``runs`` has ``alphabet, band, value``.  P-values are compared by bins, of which there
    are at most fifty per alphabet and band, so the running counts are small tables.
    """
    from pyspark.sql import Window

    bins = runs.groupBy("alphabet", "band", "value").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("alphabet", "band")
    bins = bins.withColumns({
        "above": F.sum("n").over(group.orderBy(F.desc("value"))), "all": F.sum("n").over(group),
    })
    p = F.pow(F.lit(10.0), -F.col("value") / F.lit(float(_STEP)))
    return bins.filter(p * F.col("all") <= RATE * F.col("above")).groupBy("alphabet", "band").agg(
        F.min("value").alias("cut"))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``secrets``: ``array<struct<kind,start,end>>``, sorted by start, then kind.

    Spans are in code points, the end exclusive.  NULL and empty texts have none.  The
    columns of ``keep`` (all by default) are returned.  Texts are read once: their spans and
    test values go to a written table, from which the corpus-wide thresholds are taken.
    A threshold per alphabet and band, 21 at most, comes to the driver.
    """
    keep = docs.columns if keep is None else keep
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base, runs = fresh(docs, "base"), fresh(docs, "runs")
    parts = [
        _ranked(_matches(body, ASSIGN, ASSIGN_CHARS), 0), _ranked(_matches(body, ACCESS), 1),
        _ranked(_matches(body, HEX), 2),
    ]
    found = docs.withColumn(base, F.concat(*parts)).withColumn(runs, _tested(body))
    found = stored(found.select(*[F.col(f"`{name}`") for name in keep], base, runs), "secrets")
    cuts = {(r.alphabet, r.band): r.cut for r in thresholds(found.select(F.inline(runs))).collect()}
    return found.withColumn("secrets", _named(F.col(base), F.col(runs), cuts)).drop(base, runs)


def _ranked(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end")))


def _named(base: Column, runs: Column, cuts: dict) -> Column:
    def kept(run):
        judged = run["band"] >= TELLING_BAND  # without a threshold nothing was set aside
        for (alphabet, band), cut in sorted(cuts.items()):
            judged = F.when((run["alphabet"] == alphabet) & (run["band"] == band), run["value"] < cut).otherwise(judged)
        return judged

    extra = _ranked(F.filter(runs, kept), 3)
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.transform(F.array_sort(F.concat(base, extra)), lambda s: F.struct(
        F.get(names, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redact(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """Replace each secret in ``text`` by ``[kind]``; overlapping ones become the first one's mark.

    The secrets of a text are cut out in chunks, each from its own piece of the text, so
    that neither what is done nor what is left is copied for every secret.
    """
    body = F.col(f"`{text}`")

    def cut_chunk(state, chunk):
        begin = state["at"]
        end = F.greatest(begin, F.array_max(F.transform(chunk, lambda s: s["end"])))

        def within(piece):
            def cut(inner, s):
                before = F.substring(piece, inner["at"] - begin + 1, s["start"] - inner["at"])
                marked = F.concat(inner["out"], before, F.lit("["), s["kind"], F.lit("]"))
                return F.struct(
                    F.greatest(inner["at"], s["end"]).alias("at"),
                    F.when(s["start"] >= inner["at"], marked).otherwise(inner["out"]).alias("out"))

            return F.aggregate(chunk, F.struct(begin.alias("at"), F.lit("").alias("out")), cut)

        done = _bound(F.substring(body, begin + 1, end - begin), within)
        return _bound(done, lambda d: F.struct(
            d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(_chunks(F.col(f"`{secrets}`")), zero, cut_chunk, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(body, s["at"] + 1, F.length(body))))
    return docs.withColumn(text, F.when(F.size(f"`{secrets}`") > 0, clean).otherwise(body)).drop(secrets)
