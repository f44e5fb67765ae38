"""Surrogates for personal data, in DataFrame functions only.

E-mail addresses, telephone numbers, IPv4 addresses, card numbers and names after a title
are replaced by others of their kind.  A surrogate comes from a keyed permutation of all
values of the same shape (a four-round Feistel network whose round function is SHA-256
of the key and the other half), so

* equal entities have equal surrogates everywhere, however a number is punctuated or an
  address is capitalised (coreference),
* different entities have different surrogates (a permutation has no collisions within a kind),
* letters stay letters of their script and case, vowels of names stay vowels, digits stay
  digits, and punctuation stays; card numbers keep or miss their check digit as before.

A name keeps its title and the last letter of its words, and with them its gender.  What a permutation
cannot see is a surrogate that is a real entity elsewhere, or the entity itself.  ``replace_checked``
holds every surrogate against all entities of the corpus and draws those again by further keys.

What is checked and drawn is a unit: an e-mail address in small letters, the octets of an IPv4
address, the digits of a card, the last ten digits of a telephone number, a word of a name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiflux.llm.common import fresh
from epiflux.operators.relational import lookup
from epiflux.session import stored

# Patterns of entities, and the alphabets whose letters stand for each other.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9][A-Za-z0-9-]*)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{4}(?![0-9])"
PHONE = "|".join([
    r"(?<![0-9])(?:\+|00)[1-9](?:[ ./()-]{0,2}[0-9]){7,13}(?![0-9])",
    r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9])\(?0[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9])",
    r"(?<![\p{L}0-9_.+-])(?:[0-9]{10}|[0-9]{3}[ .-][0-9]{7})(?![\p{L}0-9_]|\.[0-9])",
])
TITLE = (
    r"\b(?:(?:Mrs|Mr|Ms|Mx|Miss|Dr|Prof|Professor|Sir|Herrn|Herr|Frau|Doktor|Monsieur|Madame|Mademoiselle|Mme|Mlle|"
    r"Señora|Señorita|Señor|Sra|Srta|Sr|Dra|Doctora|Doctor|Господин|Госпожа|Доктор|Профессор)\.? )+"
)
PARTICLES = ("von", "van", "der", "den", "dem", "de", "del", "della", "da", "di", "du", "la", "le", "zu", "zur", "bin", "ibn", "al", "el", "y")
_WORD = r"(?:[dl]['’])?\p{Lu}[\p{L}\p{M}]*(?:['’]\p{Lu}[\p{L}\p{M}]*|-\p{L}[\p{L}\p{M}]*)*(?:(?<=\b\p{Lu})\.(?= ?\p{Lu}))?"
_PARTICLE = f"(?:(?:{'|'.join(PARTICLES)}) )"
NAME = f"{_PARTICLE}*{_WORD}(?: {_PARTICLE}*{_WORD})*"
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
SOUNDS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "0123456789",
)
# End of the fixed values.

KINDS = ("email", "ip", "card", "phone", "name")
PATTERN = "|".join([EMAIL, IPV4, CARD, PHONE, f"{TITLE}{NAME}"])
_ROUNDS = 4

#: How often a unit whose surrogate is taken draws again before what is left changes places.
REDRAWS = 64

#: Turns that draw side by side.
ROUND = 16

#: Most rows of redrawn units, or of texts with their units, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _noise(key: str | Column, kind: str, turn: int, other: Column) -> Column:
    """Sixty-four hexadecimal digits that depend on the key, the turn and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(turn)), other), 256)


def _moved(text: Column, noise: Column, alphabets: tuple[str, ...], sign: int = 1) -> Column:
    """Each letter moved along its alphabet by the noise, keeping its case; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(noise, F.pmod(i * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
        low = F.lower(c)
        out = low
        for alphabet in alphabets:
            at = F.instr(F.lit(alphabet), low)
            to = F.pmod(at - 1 + sign * step, F.lit(len(alphabet))) + 1
            out = F.when(at > 0, F.substring(F.lit(alphabet), to, F.lit(1))).otherwise(out)
        return F.when(c != low, F.upper(out)).otherwise(out)

    # an empty text splits into one empty text, which is no letter
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def permuted(text: Column, key: str, kind: str, alphabets: tuple[str, ...], back: bool = False) -> Column:
    """The keyed permutation of texts of one shape, or its inverse."""
    half = F.ceil(F.length(text) / 2).cast("int")
    state = F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))
    for turn in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
        state = _turned(state, key, kind, turn, alphabets, -1 if back else 1)
    return F.array_join(state, "")


def _turned(state: Column, key: str, kind: str, turn: int, alphabets: tuple[str, ...], sign: int) -> Column:
    """One round; a transform over a single element names the state, so that it is computed once."""
    moved, other = turn % 2, 1 - turn % 2

    def step(s: Column) -> Column:
        new = _moved(F.get(s, F.lit(moved)), _noise(key, kind, turn, F.lower(F.get(s, F.lit(other)))), alphabets, sign)
        return F.array(new, F.get(s, F.lit(1))) if moved == 0 else F.array(F.get(s, F.lit(0)), new)

    return F.get(F.transform(F.array(state), step), F.lit(0))


def _named(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits_put(form: Column, digits: Column) -> Column:
    """The form with its digits, in turn, replaced by others."""

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(form, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _check_sum(digits: Column) -> Column:
    """Luhn sum modulo ten of digits whose last is the check digit."""

    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        twice = 2 * n - F.when(n > 4, 9).otherwise(0)
        return F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 0, twice).otherwise(n)

    values = F.transform(F.split(digits, ""), value)
    return F.pmod(F.aggregate(values, F.lit(0), lambda s, n: s + n), F.lit(10))


def _card(form: Column, key: str) -> Column:
    def put(digits: Column) -> Column:
        body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", LETTERS)

        def checked(new: Column) -> Column:
            # the last digit makes the sum what it was
            last = F.pmod(_check_sum(digits) - _check_sum(F.concat(new, F.lit("0"))), F.lit(10))
            return F.concat(new, last.cast("string"))

        return _named(body, checked)

    return _digits_put(form, _named(F.regexp_replace(form, "[^0-9]", ""), put))


def _phone(form: Column, key: str) -> Column:
    """The last ten digits move; a country's prefix before them stays."""
    digits = F.regexp_replace(form, "[^0-9]", "")
    return _digits_put(form, _named(digits, lambda d: F.concat(
        F.substring(d, F.lit(1), F.greatest(F.lit(0), F.length(d) - 10)),
        permuted(F.substring(d, F.greatest(F.lit(1), F.length(d) - 9), F.lit(10)), key, "phone", LETTERS))))


def _ip(form: Column, key: str) -> Column:
    """Two pairs of octets, each moved by the other modulo 256."""
    state = F.transform(F.split(form, r"\."), lambda octet: octet.cast("int"))
    for turn in range(_ROUNDS):
        mine = (0, 1) if turn % 2 == 0 else (2, 3)
        other = (2, 3) if turn % 2 == 0 else (0, 1)
        state = _ip_turned(state, key, turn, mine, other)
    return F.array_join(F.transform(state, lambda octet: octet.cast("string")), ".")


def _ip_turned(state: Column, key: str, turn: int, mine: tuple[int, int], other: tuple[int, int]) -> Column:
    def step(s: Column) -> Column:
        noise = _noise(key, "ip", turn, F.concat_ws(".", *[F.get(s, F.lit(i)).cast("string") for i in other]))
        octets = [F.get(s, F.lit(i)) for i in range(4)]
        for place, i in enumerate(mine):
            move = F.conv(F.substring(noise, 1 + 8 * place, 6), 16, 10).cast("int")
            octets[i] = F.pmod(octets[i] + move, F.lit(256))
        return F.array(*octets)

    return F.get(F.transform(F.array(state), step), F.lit(0))


def _email(form: Column, key: str) -> Column:
    """Everything but the last label moves."""
    body, ending = F.regexp_extract(form, r"^(.*)(\.[A-Za-z]+)$", 1), F.regexp_extract(form, r"(\.[A-Za-z]+)$", 1)
    return F.concat(permuted(body, key, "email", LETTERS), ending)


def _name_parts(form: Column) -> Column:
    """Words of the name after its title, and what stands between them."""
    name = F.regexp_replace(form, f"^{TITLE}", "")
    return F.regexp_extract_all(name, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))


def _name(form: Column, key: str, drawn=None) -> Column:
    """Each word after the title moves but for its last letter; words of one or two letters move whole.

    Words move one by one, so a surname has one surrogate whatever stands before it.
    """
    title, parts = F.regexp_extract(form, f"^{TITLE}", 0), _name_parts(form)

    def moved(part: Column) -> Column:
        new = _word(part, key)
        if drawn is not None:
            new = F.coalesce(_cased(part, drawn("name", F.lower(part))), new)
        return F.when(_moves(part), new).otherwise(part)

    return F.concat(title, F.array_join(F.transform(parts, moved), ""))


def _moves(part: Column) -> Column:
    return part.rlike(r"^\p{L}") & ~part.isin(*PARTICLES)


def _word(word: Column, key: str) -> Column:
    kept = F.when(F.length(word) > 2, 1).otherwise(0)
    body = F.substring(word, F.lit(1), F.length(word) - kept)
    return F.concat(permuted(body, key, "name", SOUNDS), F.substring(word, F.length(word) - kept + 1, kept))


def _cased(form: Column, value: Column) -> Column:
    """The value with capitals where the form has them; NULL for NULL."""

    def one(c: Column, i: Column) -> Column:
        new = F.substring(value, i + 1, F.lit(1))
        return F.when(c != F.lower(c), F.upper(new)).otherwise(new)

    same = F.length(form) == F.length(value)
    return F.when(same, F.array_join(F.transform(F.split(form, ""), one), "")).otherwise(value)


def kind_of(entity: Column) -> Column:
    return F.when(entity.contains("@"), "email").when(entity.rlike(f"^(?:{IPV4})$"), "ip").when(
        entity.rlike(f"^(?:{CARD})$"), "card").when(entity.rlike("^[^0-9]+$"), "name").otherwise("phone")


def units_of(kind: Column, entity: Column) -> Column:
    """The units of an entity: what has one surrogate wherever it stands."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    octets = F.transform(F.split(entity, r"\."), lambda octet: octet.cast("int").cast("string"))
    words = F.transform(F.filter(_name_parts(entity), _moves), F.lower)
    return (
        F.when(kind == "email", F.array(F.lower(entity))).when(kind == "ip", F.array(F.array_join(octets, ".")))
        .when(kind == "card", F.array(digits)).when(kind == "name", words)
        .otherwise(F.array(F.substring(digits, F.greatest(F.lit(1), F.length(digits) - 9), F.lit(10))))
    )


def drawn_unit(kind: Column, unit: Column, key: str | Column) -> Column:
    """The surrogate of a unit."""
    return (
        F.when(kind == "email", _email(unit, key)).when(kind == "ip", _ip(unit, key))
        .when(kind == "card", _card(unit, key)).when(kind == "name", _word(unit, key))
        .otherwise(permuted(unit, key, "phone", LETTERS))
    )


def _shape(kind: Column, unit: Column) -> Column:
    """Equal for the units that one permutation moves among each other."""
    body = F.when(kind == "email", F.regexp_extract(unit, r"^(.*)\.[a-z]+$", 1)).when(
        kind == "name", F.substring(unit, F.lit(1), F.length(unit) - F.when(F.length(unit) > 2, 1).otherwise(0))).otherwise(unit)
    form = F.when(kind == "ip", "").otherwise(body)
    for sign, alphabet in enumerate(SOUNDS[:-1]):
        form = F.when(kind == "name", F.translate(form, alphabet, str(sign) * len(alphabet))).otherwise(form)
    form = F.when(kind == "name", form).otherwise(F.translate(form, "".join(LETTERS), "a" * 26 + "0" * 10))
    rest = F.when(kind == "card", _check_sum(unit).cast("string")).when(kind == "ip", "").otherwise(
        F.substring(unit, F.length(body) + 1, F.length(unit)))
    return F.concat_ws("|", form, rest)


def surrogate(entity: Column, key: str, redrawn: Column | None = None) -> Column:
    """The replacement of a matched entity; ``redrawn`` maps ``kind:unit`` to the units that were drawn again."""
    kind = kind_of(entity)
    if redrawn is None:
        drawn = None
    else:
        def drawn(kind: str, unit: Column) -> Column:
            return F.try_element_at(redrawn, F.concat(F.lit(f"{kind}:"), unit))

    def either(kind: str, usual: Column, put) -> Column:
        if drawn is None:
            return usual
        return F.coalesce(put(drawn(kind, F.get(units_of(F.lit(kind), entity), F.lit(0)))), usual)

    digits = F.regexp_replace(entity, "[^0-9]", "")
    before = F.substring(digits, F.lit(1), F.greatest(F.lit(0), F.length(digits) - 10))
    return (
        F.when(kind == "email", either("email", _email(entity, key), lambda new: _cased(entity, new)))
        .when(kind == "ip", either("ip", _ip(entity, key), lambda new: new))
        .when(kind == "card", either("card", _card(entity, key), lambda new: _put(entity, new)))
        .when(kind == "name", _name(entity, key, drawn))
        .otherwise(either("phone", _phone(entity, key), lambda new: _put(entity, F.concat(before, new))))
    )


def _put(form: Column, digits: Column) -> Column:
    return F.when(digits.isNotNull(), _digits_put(form, digits))


def replace(docs: DataFrame, key: str, text: str = "text", redrawn: str | None = None) -> DataFrame:
    """``text`` with surrogates, and ``entities``: ``array<struct<kind,start,end,surrogate>>``.

    Spans are in code points of the original, the end exclusive.  NULL stays NULL; texts
    without entities stay as they are.  Rows are independent: no shuffle.  ``key`` decides
    all surrogates; whoever has it can undo them.  ``redrawn`` names a column with a map of
    the units of the row that have another surrogate, as ``replace_checked`` finds them.
    """
    others = None if redrawn is None else F.col(f"`{redrawn}`")
    body = F.col(f"`{text}`")
    gaps, hits = F.split(body, PATTERN, -1), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    steps, found = fresh(docs, "steps"), F.coalesce(body.rlike(PATTERN), F.lit(False))
    paired = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    with_new = F.transform(paired, lambda s: F.struct(
        s["gap"].alias("gap"), s["hit"].alias("hit"), F.when(s["hit"].isNotNull(), surrogate(s["hit"], key, others)).alias("new")))
    docs = docs.withColumn(steps, F.when(found, with_new))

    def place(state, s):
        start = state["at"] + F.length(s["gap"])
        end = start + F.coalesce(F.length(s["hit"]), F.lit(0))
        one = F.struct(kind_of(s["hit"]).alias("kind"), start.alias("start"), end.alias("end"), s["new"].alias("surrogate"))
        return F.struct(end.alias("at"), F.when(
            s["hit"].isNotNull(), F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int,surrogate:string>>")
    spans = F.aggregate(F.col(steps), F.struct(F.lit(0).alias("at"), empty.alias("out")), place, lambda s: s["out"])
    joined = F.array_join(F.transform(steps, lambda s: F.concat(s["gap"], F.coalesce(s["new"], F.lit("")))), "")
    return docs.withColumn("entities", F.coalesce(spans, empty)).withColumn(
        text, F.when(F.col(steps).isNotNull(), joined).otherwise(body)).drop(steps)


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """``digest, kind, unit``: the distinct units of each distinct text."""
    body = F.col(f"`{text}`")
    # the outer form keeps the optimizer from pushing an emptiness test, and with it a second extraction, below
    hits = docs.select(
        F.xxhash64(body).alias("digest"),
        F.explode_outer(F.array_distinct(F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))).alias("hit"))
    kinds = hits.filter(F.col("hit").isNotNull()).select("digest", "hit", kind_of(F.col("hit")).alias("kind"))
    return kinds.select("digest", "kind", F.explode(units_of(F.col("kind"), F.col("hit"))).alias("unit")).distinct()


def redraw(units: DataFrame, key: str, turns: int = REDRAWS) -> DataFrame:
    """``kind, unit, value`` of the units whose surrogate is a unit of the corpus, or the unit itself.

    ``units`` are all distinct ``kind, unit``, a written table.  Units whose first draw is taken
    draw ``turns`` times more, by other keys, sixteen turns a round.  In a round, a value that is
    neither a unit nor a surrogate yet goes to the earliest turn that drew it, and each unit takes
    its earliest value; units without one go on to the next round, up to one that finds nothing.
    The draws of a turn are a permutation, so no two units ever have the same value.  Where nearly all
    values of a shape are units, as with initials, some units get none; these change places
    within their shape, in an order that the key decides, so that none keeps its own text.  Only
    a unit that is left alone in its shape keeps its first draw, and with it perhaps its text.
    """
    kind, unit = F.col("kind"), F.col("unit")

    def free(drawn: DataFrame, taken: DataFrame) -> DataFrame:
        hit = taken.join(drawn.select("kind", "value"), ["kind", "value"], "left_semi").distinct()
        return drawn.join(hit, ["kind", "value"], "left_anti")

    own = units.select("kind", F.col("unit").alias("value"))
    first = stored(units.select("kind", "unit", drawn_unit(kind, unit, key).alias("value")), "pii-first")
    left = stored(first.join(free(first, own).select("kind", "unit"), ["kind", "unit"], "left_anti"), "pii-left")
    if left.isEmpty():
        return left
    taken, chosen = own.unionByName(first.select("kind", "value")), []
    for start in range(1, turns + 1, ROUND):
        numbers = F.sequence(F.lit(start), F.lit(min(turns, start + ROUND - 1)))
        turned = left.select("kind", "unit", F.explode(numbers).alias("turn"))
        other = F.concat(F.lit(f"{key}#"), F.col("turn").cast("string"))
        drawn = stored(turned.select("*", drawn_unit(kind, unit, other).alias("value")), "pii-draws")
        owned = free(drawn, taken).groupBy("kind", "value").agg(F.min(F.struct("turn", "unit")).alias("by"))
        found = stored(owned.groupBy("kind", F.col("by.unit").alias("unit")).agg(
            F.min_by("value", "by.turn").alias("value")), "pii-found")
        if found.isEmpty():
            break
        chosen.append(found)
        taken = taken.unionByName(found.select("kind", "value"))
        left = stored(left.join(found.select("kind", "unit"), ["kind", "unit"], "left_anti"), "pii-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, chosen)
    shaped = left.select(
        "*", _shape(kind, unit).alias("shape"), _noise(key, "order", 0, unit).alias("place"))
    ring = Window.partitionBy("kind", "shape").orderBy("place", "unit")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("unit").over(ring), F.first("unit").over(whole))
    changed = shaped.select("kind", "unit", "value", after.alias("after")).select(
        "kind", "unit", F.when(F.col("after") != unit, F.col("after")).otherwise(F.col("value")).alias("value"))
    return reduce(DataFrame.unionByName, [*chosen, changed])


def replace_checked(docs: DataFrame, key: str, text: str = "text", turns: int = REDRAWS) -> DataFrame:
    """``replace`` with no surrogate that is an entity of the corpus, as far as ``redraw`` finds others.

    The texts are read once for their units and once to be replaced.  Few units are drawn
    again; texts that hold one get a map of them by a digest of the text, over a broadcast
    of at most ``BROADCAST_ROWS`` counted rows or else over a shuffle.  Two texts of
    one digest would share a map, which changes nothing, as a unit has one surrogate
    everywhere.  Rows, NULL, empty texts and other columns are as in ``replace``; repeated
    rows get the same surrogates.
    """
    found = stored(mentions(docs, text), "pii-mentions")
    units = stored(found.select("kind", "unit").distinct(), "pii-units")
    drawn = stored(redraw(units, key, turns), "pii-redrawn")
    if drawn.isEmpty():
        return replace(docs, key, text)
    if drawn.count() <= BROADCAST_ROWS:
        met = found.join(F.broadcast(drawn), ["kind", "unit"])
    else:
        met = lookup(found, drawn, ["kind", "unit"], "inner", spread_by="digest")
    met = stored(met, "pii-met")
    digest, redrawn = fresh(docs, "_digest"), fresh(docs, "_redrawn")
    entry = F.struct(F.concat_ws(":", "kind", "unit"), F.col("value"))
    maps = met.groupBy(F.col("digest").alias(digest)).agg(F.map_from_entries(F.collect_set(entry)).alias(redrawn))
    maps = F.broadcast(maps) if met.count() <= BROADCAST_ROWS else maps
    keyed = docs.withColumn(digest, F.xxhash64(F.col(f"`{text}`"))).join(maps, digest, "left")
    return replace(keyed, key, text, redrawn).drop(digest, redrawn)


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``kind, value``: whole surrogates of ``replace`` that are entities of the corpus themselves; usually none.

    ``replace_checked`` draws these again.  Entities are reduced before they move.
    """
    hits = docs.select(F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(PATTERN), F.lit(0))).alias("value"))
    hits = hits.distinct().withColumn("kind", kind_of(F.col("value")))
    made = hits.select("kind", surrogate(F.col("value"), key).alias("value")).distinct()
    return made.join(hits, ["kind", "value"], "left_semi")
