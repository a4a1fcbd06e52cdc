"""Surrogate generation for personal data.

Detected entities get keyed replacements of the same kind, format, script and (names)
gender.  One entity has one replacement wherever it occurs and however it is written; two
entities never share one, and no replacement is itself an entity of the input.  Built-in
functions only.

Kinds: email, phone, ip, card (13 to 19 digits that pass the Luhn check and begin with 2 to 6;
in a run of numbers each card layout is tested on its own, so a date, a security code or
another number beside a card stays; other long numbers stay), ssn, iban, hex (keys and tokens of 32 and
more hexadecimal digits), and the words of a person's name after a title or a known given
name (given name by gender, surname).  A card number or IBAN that passes its checksum gets
one that passes too.  Case and separators of each place are kept; private address ranges,
reserved ``example`` domains, country codes and the fictional 555 exchange stay as such.
Words of a name found in this way (surnames, and given names of the list) are also replaced
where they stand alone in the same text, capitalised or in capitals, unless the text has the
word in small letters too, as it has common words; hyphens, apostrophes and capitals within a
name are part of it.  A given name has the gender of its title, else that of the list.
From turn ``WIDE`` on, where a format has too few free values, replacements of e-mails, names
and phones get longer and private addresses move to other reserved ranges.

Undefined cases: null stays null and empty stays empty; a text of any length is replaced
as a whole; repeated rows get equal results.  Overlapping readings of one place are taken
from left to right, the first kind in ``_PATTERN`` first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.frames import fresh, quoted
from factorloom.session import materialize

# Titles and common given names by gender, syllables by script.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Lord", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita",
                 "Sra", "Lady", "Госпожа"]
OTHER_TITLES = ["Dr", "Prof", "Mx"]
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul",
              "Hans", "Jürgen", "Klaus", "Pierre", "Jean", "Jacques", "Carlos", "José", "Juan",
              "Иван", "Сергей", "Дмитрий"]
FEMALE_NAMES = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna",
                "Ursula", "Ingrid", "Sabine", "Marie", "Sophie", "Camille", "María", "Carmen",
                "Lucía", "Анна", "Мария", "Ольга"]
LATIN_SYLLABLES = ["ba", "be", "da", "do", "fa", "fe", "ga", "ha", "ka", "ke", "la", "le", "ma",
                   "me", "mo", "na", "ne", "pa", "ra", "re", "ro", "sa", "se", "ta", "te", "va"]
CYRILLIC_SYLLABLES = ["ба", "ва", "га", "да", "за", "ка", "ла", "ле", "ма", "ме", "на", "ни", "па",
                      "ра", "ре", "ро", "са", "се", "та", "те"]
ENDINGS = {("latin", "given_m"): ["n", "s", "rt", "k"], ("latin", "given_f"): ["a", "ia", "ine", "elle"],
           ("latin", "given_n"): ["ri", "ly", "ny"], ("latin", "surname"): ["son", "ler", "mann", "well"],
           ("cyrillic", "given_m"): ["н", "р", "й"], ("cyrillic", "given_f"): ["на", "я", "ла"],
           ("cyrillic", "given_n"): ["ша", "ня"], ("cyrillic", "surname"): ["ов", "ин", "ко"]}

_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}{1,30}(?:[\-'’]?\p{Lu}\p{Ll}{1,30}){0,3}"
_ALL_TITLES = MALE_TITLES + FEMALE_TITLES + OTHER_TITLES
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# A run of numbers ends before what another kind takes.
_STOP = (rf"(?!(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)|\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}(?![\d.\-])"
         r"|\d{3}-\d{2}-\d{4}(?![\d\-]))")
_PARTS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "hex": r"\b(?=\p{XDigit}*\d)\p{XDigit}{32,}+\b",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
             r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d.\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": rf"(?<![\w.\-])(?=\d(?:[ \-]?\d){{12}})\d++(?!\w)(?:[ \-]{_STOP}\d++(?!\w))*+",
    "person": rf"\b(?:{'|'.join(_ALL_TITLES)})\b\.? {_NAME}(?: {_NAME})?"
              rf"|\b(?:{'|'.join(MALE_NAMES + FEMALE_NAMES)})(?:-\p{{Lu}}\p{{Ll}}{{1,30}})? {_NAME}",
}
_PATTERN = "|".join(f"(?:{p})" for p in _PARTS.values())
CARD_LAYOUT = r"^(?:\d{13,19}|\d{4}(?: \d{4}){3}(?: \d{1,3})?|\d{4} \d{6} \d{4,5})$"
MAX_ROUNDS = 24
WIDE = 5


def find(text: Column) -> Column:
    """All matches of a text, as written, from left to right, but for names that stand alone; a
    run of numbers is one."""
    return F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0))


def _alone(text: Column, people: Column) -> Column:
    """The names in the matches ``people`` of a text as an alternative to ``_PATTERN`` that finds
    them standing alone; NULL if there are none.  Only names whose kind can be told from the
    word itself take part, so that a place has the same replacement as the marked one."""
    words = F.flatten(F.transform(people, lambda w: F.filter(
        _words(w), lambda x: x["kind"] == _kind_alone(x["surface"]))))
    in_text = F.split(text, r"[^\p{L}\p{M}'’\-]+")
    common = F.array_intersect(F.transform(words, lambda x: F.lower(x["surface"])), in_text)
    names = F.array_distinct(F.transform(F.filter(
        words, lambda x: ~F.array_contains(common, F.lower(x["surface"]))), lambda x: x["surface"]))
    forms = F.array_join(F.array_union(names, F.transform(names, F.upper)), "|")
    return F.when(forms != "", F.concat(F.lit(r"|(?<![\p{L}\p{N}\-])(?:"), forms,
                                        F.lit(r")(?![\p{L}\p{N}]|-\p{Lu})")))


def found(df: DataFrame, text: str, matches: str, alone: str) -> DataFrame:
    """``df`` with the matches of ``text`` and what finds the names that stand alone in it."""
    people = fresh(df, "people")
    out = df.withColumn(matches, find(F.col(text)))
    out = out.withColumn(people, F.filter(matches, lambda w: w.rlike(f"^(?:{_PARTS['person']})$")))
    out = out.withColumn(alone, F.when(F.size(people) > 0, _alone(F.col(text), F.col(people)))).drop(people)
    return out.withColumn(matches, F.when(F.col(alone).isNull(), F.col(matches)).otherwise(
        F.regexp_extract_all(F.col(text), F.concat(F.lit(_PATTERN), F.col(alone)), F.lit(0))))


def entities(df: DataFrame, text: str, name: str) -> DataFrame:
    """What ``replace`` counts: the matches of a text, a run of numbers with cards as its cards."""
    alone = fresh(df, "alone")
    return found(df, text, name, alone).drop(alone).withColumn(name, F.flatten(F.transform(name, lambda w: F.when(
        F.size(_run(w)) > 0, F.transform(F.filter(_divided(w, _run(w)), lambda x: x["kind"] == "card"),
                                         lambda x: x["surface"])).otherwise(F.array(w)))))


def _kind(surface: Column) -> Column:
    """The kind of a match; NULL for a long number that is no card."""
    digits = F.regexp_replace(surface, r"\D", "")
    tests = [F.when(surface.rlike(f"^(?:{p})$"), k) for k, p in _PARTS.items() if k != "person"]
    kind = F.coalesce(*tests, F.lit("person"))
    return F.when((kind != "card") | _is_card(digits), kind)


def _is_card(digits: Column) -> Column:
    return digits.rlike(r"^[2-6]\d{12,18}$") & (_luhn(digits) == 0)


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _number(digest: Column, place: Column) -> Column:
    """The byte of a hexadecimal digest (128 bytes) at ``place``, counted from 0."""
    return F.conv(F.substring(digest, F.pmod(place, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digest(key: str, kind: Column, value: Column, turn: Column) -> Column:
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), kind, value, turn.cast("string"), F.lit(k)), 512)
                      for k in "01"])


def _pick(values: list[str], number: Column) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, F.pmod(number, F.lit(len(values))).cast("int") + 1)


def _swapped(value: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Each digit becomes a digit and each letter a letter of its script; others stay."""
    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        letter = _pick(list("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"), n)
        cyrillic = _pick(list("абвгдежзиклмнопрстуфхцчшэюя"), n)
        any_hex = _pick(list("0123456789abcdef"), n)
        lower = (F.when(c.rlike(r"[0-9a-fA-F]"), any_hex) if hexadecimal else
                 F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
                 .when(c.rlike(r"\p{IsCyrillic}"), cyrillic).when(c.rlike(r"\p{L}"), letter)).otherwise(c)
        return F.when(c.rlike(r"\p{Lu}"), F.upper(lower)).otherwise(lower)

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    reverse = F.reverse(_chars(digits))
    doubled = F.transform(reverse, lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10


def _mod97(iban: Column) -> Column:
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    numbers = F.array_join(F.transform(_chars(moved), lambda c: F.when(c.rlike("[0-9]"), c)
                                       .otherwise((F.ascii(c) - 55).cast("string"))), "")
    return F.aggregate(_chars(numbers), F.lit(0), lambda s, c: (s * 10 + c.cast("int")) % 97)


def _canonical(kind: Column, surface: Column) -> Column:
    """What is the same for all ways to write one entity."""
    digits = F.regexp_replace(surface, r"\D", "")
    return (F.when(kind.isin("email", "hex"), F.lower(surface))
            .when(kind == "phone", F.concat(F.when(surface.startswith("+"), "+").otherwise(""), digits))
            .when(kind.isin("card", "ssn"), digits)
            .when(kind == "iban", F.regexp_replace(surface, " ", ""))
            .when(kind == "ip", surface).otherwise(F.lower(surface)))


def _surrogate(kind: Column, value: Column, turn: Column, key: str) -> Column:
    """The canonical form of the replacement that ``value`` gets in a turn."""
    digest = _digest(key, kind, value, turn)
    longer = F.greatest(turn - WIDE + 1, F.lit(0))
    extra = F.substring(digest, F.lit(201), longer)
    letters = F.translate(extra, "0123456789", "ghijklmnop")
    cyrillic = F.translate(extra, "0123456789abcdef", "абвгдежзиклмнопр")
    swapped = _swapped(value, digest)
    local = F.substring_index(swapped, "@", 1)
    host = F.substring_index(value, "@", -1)
    reserved = F.regexp_extract(host, r"(?:^|\.)(example\.(?:com|org|net)|[^.]+\.example|example)$", 1)
    site = _swapped(F.when(reserved != "", F.expr("''")).otherwise(F.substring_index(host, ".", 1)), digest)
    prefix = F.substring(host, F.lit(1), F.length(host) - F.length(reserved))
    email = F.concat(local, letters, F.lit("@"), F.when(reserved != "", F.concat(
        _swapped(prefix, F.reverse(digest)), reserved)).otherwise(F.concat(site, F.lit(".example"))))
    octets = [_number(digest, F.lit(k)) for k in range(4)]
    private = F.regexp_extract(value, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    parts = [(octets[0] % 223 + 1), octets[1], octets[2], octets[3] % 254 + 1]
    address = F.concat_ws(".", *[p.cast("string") for p in parts])
    kept = F.size(F.split(private, r"\.")) - 1
    other = F.when(turn < (WIDE + MAX_ROUNDS) // 2, F.lit("10")).otherwise((octets[0] % 16 + 240).cast("string"))
    address = F.when(private == "", address).when(turn >= WIDE, F.concat_ws(
        ".", other, *[p.cast("string") for p in parts[1:]])).otherwise(F.concat(
        private, F.array_join(F.slice(F.split(address, r"\."), kept + 1, F.lit(4) - kept), ".")))
    code = F.regexp_extract(value, r"^(\+(?:[17]|\d{2}))", 1)
    national = F.substring(swapped, F.length(code) + 1, F.length(swapped))
    real = F.substring(value, F.length(code) + 1, F.length(value))
    fictional = (F.substring(real, 4, 3) == "555") & (F.length(real) == 10) & (turn < 4)
    phone = F.concat(code, F.when(fictional, F.concat(
        F.substring(national, 1, 3), F.lit("555"), F.substring(national, 7, 4))).otherwise(national),
        F.translate(extra, "abcdef", "012345"))
    stem = F.concat(F.substring(value, 1, 1), F.substring(swapped, F.lit(2), F.length(swapped) - 2))
    check = F.pmod(F.lit(10) - _luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(stem, check)
    land = F.substring(value, 1, 2)
    account = F.substring(swapped, F.lit(5), F.length(swapped))
    control = F.lpad((F.lit(98) - _mod97(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(land, F.when(_mod97(value) == 1, control).otherwise(F.substring(swapped, 3, 2)), account)
    names = [F.when((kind == k) & (value.rlike(r"\p{IsCyrillic}") == (script == "cyrillic")), F.concat(
        *[_pick(CYRILLIC_SYLLABLES if script == "cyrillic" else LATIN_SYLLABLES, _number(digest, F.lit(i)))
          for i in range(3)],
        F.when(turn > 0, _pick(CYRILLIC_SYLLABLES if script == "cyrillic" else LATIN_SYLLABLES,
                               _number(digest, F.lit(7)))).otherwise(""),
        F.when(turn > 3, _pick(CYRILLIC_SYLLABLES if script == "cyrillic" else LATIN_SYLLABLES,
                               _number(digest, F.lit(8)))).otherwise(""),
        cyrillic if script == "cyrillic" else letters,
        _pick(ends, _number(digest, F.lit(9)))))
        for (script, k), ends in ENDINGS.items()]
    return (F.when(kind == "email", email).when(kind == "ip", address).when(kind == "phone", phone)
            .when(kind == "card", card).when(kind == "iban", iban).when(kind == "ssn", swapped)
            .when(kind == "hex", _swapped(value, digest, hexadecimal=True))
            .otherwise(F.coalesce(*names)))


def _written(kind: Column, surface: Column, value: Column) -> Column:
    """A replacement in the case and with the separators of the place."""
    mark = F.when(kind == "iban", F.lit("[^A-Z0-9]")).otherwise(F.lit(r"\D"))
    bare = F.regexp_replace(value, r"^\+", "")
    filled = F.array_join(F.transform(_chars(surface), lambda c, i: F.when(
        F.regexp_replace(c, mark, F.lit("")) == "", c).otherwise(F.substring(
            bare, F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), mark, F.lit(""))),
            F.lit(1)))), "")
    filled = F.when(kind == "phone", F.concat(filled, F.substring(  # a longer number goes on after the last place
        bare, F.length(F.regexp_replace(surface, r"\D", "")) + 1, F.length(bare)))).otherwise(filled)
    shown = F.when(kind.isin("phone", "card", "ssn", "iban"), filled).otherwise(value)
    return (F.when(kind.rlike("^(given|surname)"), F.when(
        (F.length(surface) > 1) & (F.upper(surface) == surface), F.upper(shown)).otherwise(F.initcap(shown)))
        .when(kind.isin("email", "hex") & (F.upper(surface) == surface) & (F.lower(surface) != surface),
              F.upper(shown)).otherwise(shown))


def _words(surface: Column) -> Column:
    """The words of a person's name with their kinds; a title has none."""
    tokens = F.split(surface, " ")
    title = F.regexp_replace(tokens[0], r"\.$", "")
    titled = title.isin(_ALL_TITLES)

    def word(token: Column, i: Column) -> Column:
        first = F.substring_index(token, "-", 1)
        given = (F.when(title.isin(MALE_TITLES), "given_m").when(title.isin(FEMALE_TITLES), "given_f")
                 .when(first.isin(MALE_NAMES), "given_m").when(first.isin(FEMALE_NAMES), "given_f")
                 .otherwise("given_n"))
        role = (F.when(titled & (i == 0), F.lit(None).cast("string"))
                .when(F.size(tokens) == 1, _kind_alone(token))
                .when((titled & (i == 1) & (F.size(tokens) > 2)) | (~titled & (i == 0)), given)
                .otherwise("surname"))
        return F.struct(role.alias("kind"), token.alias("surface"))

    return F.transform(tokens, word)


def _kind_alone(word: Column) -> Column:
    """The kind of a name that stands alone: a given name if the list has it, else a surname."""
    proper = F.initcap(F.substring_index(word, "-", 1))
    return F.when(proper.isin(MALE_NAMES), "given_m").when(proper.isin(FEMALE_NAMES), "given_f").otherwise("surname")


def _parts(surface: Column, kind: Column, run: Column) -> Column:
    """The parts of a match: what is kept has no kind, a name is one part for each word, a run
    of numbers is divided into its cards and what lies between."""
    return (F.when(kind.eqNullSafe("person"), _words(surface))
            .when(F.size(run) > 0, _divided(surface, run))
            .otherwise(F.array(F.struct(kind.alias("kind"), surface.alias("surface")))))


def _run(surface: Column) -> Column:
    """The cards of several numbers; NULL for other matches."""
    return F.when(surface.rlike(r"^\d+(?:[ \-]\d+)+$") & surface.rlike(f"^(?:{_PARTS['card']})$"), _cards(surface))


def _cards(surface: Column) -> Column:
    """``at`` and ``n`` (place and count of numbers) of the cards in a run of numbers, from left to
    right: the longest layout that passes the Luhn check at the first number where one does."""
    numbers = F.split(surface, r"[ \-]")

    def longest(i: Column) -> Column:
        tests = []
        for n in (5, 4, 3, 1):
            part = F.slice(numbers, i + 1, F.lit(n))
            tests.append(F.when((F.size(part) == n) & F.array_join(part, " ").rlike(CARD_LAYOUT)
                                & _is_card(F.array_join(part, "")), n))
        return F.struct(i.alias("at"), F.coalesce(*tests, F.lit(0)).alias("n"))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size(numbers) - 1), longest), lambda x: x["n"] > 0)
    return F.aggregate(found, F.filter(found, lambda x: F.lit(False)), lambda kept, x: F.when(
        (F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1)["at"] + F.get(kept, F.size(kept) - 1)["n"] > x["at"]), kept)
        .otherwise(F.concat(kept, F.array(x))))


def _divided(surface: Column, cards: Column) -> Column:
    pieces = F.regexp_extract_all(surface, F.lit(r"\d+|[ \-]"), F.lit(0))  # numbers at even places

    def text(begin: Column, end: Column) -> Column:
        return F.array_join(F.slice(pieces, begin + 1, end - begin), "")

    def end(card: Column) -> Column:
        return (card["at"] + card["n"]) * 2 - 1

    def part(kind: Column, begin: Column, stop: Column) -> Column:
        return F.struct(kind.cast("string").alias("kind"), text(begin, stop).alias("surface"))

    both = F.transform(cards, lambda x, k: F.array(
        part(F.lit(None), F.coalesce(end(F.get(cards, k - 1)), F.lit(0)), x["at"] * 2),
        part(F.lit("card"), x["at"] * 2, end(x))))
    rest = part(F.lit(None), end(F.element_at(cards, -1)), F.size(pieces))
    return F.filter(F.concat(F.flatten(both), F.array(rest)), lambda x: x["surface"] != "")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value``, ``surrogate`` for distinct (``kind``, ``value``).

    Each turn offers a keyed replacement to all that have none.  An offer stands if it is
    no entity itself, was not given in an earlier turn, and no smaller value of the kind
    has the same one; the others go on.  Turns are few, each a pair of joins on a key and
    a narrow table in the shared folder.
    """
    open_ = materialize(entities.distinct(), "entities")
    taken = open_.select("kind", F.col("value").alias("surrogate"))
    settled: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        offers = open_.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), F.lit(turn), key))
        free = offers.join(taken, ["kind", "surrogate"], "left_anti")
        won = materialize(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")), "surrogates")
        settled.append(won.select("kind", "value", "surrogate"))
        open_ = materialize(open_.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "entities")
        if open_.isEmpty():
            return reduce(DataFrame.union, settled)
        taken = taken.union(won.select("kind", "surrogate"))
    raise ValueError(f"no free replacement after {MAX_ROUNDS} turns: a format has too few values, also when widened")


def replace(df: DataFrame, text: str = "text", key: str = "surrogates", row_key: str | None = "doc_id",
            counted: str = "n_entities") -> DataFrame:
    """``df`` with the entities of ``text`` replaced and their number in ``counted``.

    Entities are found in one pass and written as a narrow table; replacements are looked
    up there and come back to the texts by a plain join on a 128-bit key of (``row_key``,
    text), so that a text travels once and a frequent entity is a key of short rows only.
    """
    counted = fresh(df, counted)
    one, two = fresh(df, "key_1"), fresh(df, "key_2")
    body = F.col(text)
    lead = [F.col(row_key)] if row_key else []
    keyed = df.withColumn(one, F.xxhash64(*lead, body)).withColumn(two, F.xxhash64(body, F.lit(1), *lead))
    whole, alone = fresh(df, "whole"), fresh(df, "alone")
    # Outer explodes: for others Spark repeats the whole expression in a filter below.
    rows = (found(keyed.select(one, two, body), text, whole, alone)
            .select(F.col(one).alias("k1"), F.col(two).alias("k2"), F.col(alone).alias("alone"),
                    F.posexplode_outer(whole).alias("place", "whole")).where(F.col("place").isNotNull())
            .withColumn("run", _run(F.col("whole"))).withColumn("kind", _kind(F.col("whole"))))
    matches = materialize(
        rows.select("k1", "k2", "place", F.when(F.col("place") == 0, F.col("alone")).alias("alone"),
                    F.posexplode_outer(_parts(F.col("whole"), F.col("kind"), F.col("run"))).alias("part", "one"))
        .select("k1", "k2", "place", "alone", "part", "one.*")
        .withColumn("value", _canonical(F.col("kind"), F.col("surface"))).distinct(), "matches")
    known = assign(matches.where(F.col("kind").isNotNull()).select("kind", "value"), key)
    filled = (matches.join(known, ["kind", "value"], "left")
              .withColumn("shown", F.coalesce(_written(F.col("kind"), F.col("surface"), F.col("surrogate")),
                                              F.col("surface")))
              .groupBy("k1", "k2", "place").agg(F.sort_array(F.collect_list(F.struct("part", "shown"))).alias("parts"),
                                                F.greatest(F.max(F.col("kind").isNotNull().cast("int")),
                                                           F.count_if(F.col("kind") == "card").cast("int")).alias("real"),
                                                F.max(F.col("kind").rlike("^(given|surname)")).alias("name"),
                                                F.max("alone").alias("alone"))
              .select("k1", "k2", "place", F.when(F.col("name"), F.array_join(F.col("parts.shown"), " ")).otherwise(
                  F.array_join(F.col("parts.shown"), "")).alias("shown"), "real", "alone"))
    shown = fresh(df, "shown")
    by_text = (filled.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("place", "shown"))).alias("rows"),
                                            F.sum("real").cast("int").alias(counted), F.max("alone").alias("alone"))
               .select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("rows.shown").alias(shown),
                       F.col("alone").alias(alone), counted))
    gaps = F.split(body, F.concat(F.lit(_PATTERN), F.coalesce(F.col(alone), F.lit(""))), -1)
    joined = F.array_join(F.zip_with(gaps, F.col(shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = keyed.join(by_text, [one, two], "left")
    return out.select(*[(F.when(F.col(shown).isNull(), body).otherwise(joined).alias(text)
                         if c == text else F.col(quoted(c))) for c in df.columns],
                      F.coalesce(F.col(counted), F.lit(0)).alias(counted))
