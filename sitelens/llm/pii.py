"""PII surrogates with DataFrame functions only.

Detected entities (e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards, and names after
an honorific) are replaced by keyed surrogates of the same type and format:

* every digit becomes a digit and every letter a letter of its script and case; separators, country
  codes, top-level domains and honorifics stay; private IP ranges stay private; a card that passes
  the Luhn check keeps its issuer digit and passes it again;
* a name becomes pronounceable syllables of its script, with an ending that matches the gender of the
  honorific; each part of a name, also of one with a hyphen, has its own surrogate, so ``Mr John Smith`` and ``Mrs Smith-Jones`` still
  share a surname, and where a document names someone once with an honorific, bare mentions of those parts in it go too, in capitals as well.
  Initials become other letters, which nothing tells apart; a letter before an apostrophe stays;
* the surrogate is a function of (key, unit), a unit being a part of a name or another entity whole, so all mentions get the same one
  (coreference) without any join or shuffle of texts. Distinctness is checked over the distinct
  units of the whole table: where two have the same surrogate, or a surrogate equals a
  real unit, all but the first are drawn again, and what still collides after some draws gets the first free
  values of its form, counted through. The few entities with units that were drawn again reach
  their documents by a join, in which a small table is broadcast by its measured size only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.shared import cut

#: Draws before a unit that still collides gets a free value of its form by rank.
MAX_DRAWS = 4

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_IP6 = (
    r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
    r"|:(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])"
)
_PHONE = (
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+.-])0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}(?![\w-])"
)
#: Groups of four, American Express's groups, and runs of 13 to 19 digits (which count only if they pass the Luhn check).
_CARD = r"(?<![\w-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w])|(?<![\w-])3[47]\d{2}([ -]?)\d{6}\2\d{5}(?![\w])|(?<![\w.-])\d{13,19}(?![\w])"
#: Honorifics and the gender they tell.
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"]
MALE = ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин"]
#: Honorifics that tell none; a given name after one ends as after the second kind.
NEUTRAL = ["Dr", "Prof", "Doctor", "Professor"]
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:-(?:\p{Lu}['’])?\p{Lu}\p{L}+)*"
_INITIAL = r"\p{Lu}\."
_NAME = (
    r"(?<!\p{L})(?:" + "|".join(sorted(FEMALE + MALE + NEUTRAL, key=len, reverse=True)) + r")\.? "
    rf"(?:{_WORD} (?:{_INITIAL} ){{0,2}}|{_INITIAL} (?:{_INITIAL} )?)?{_WORD}"
)
#: What every entity has in it: a sign that is cheap to look for. Texts without it are not searched further.
HINT = r"@|[0-9][0-9. ()-]{4}|:[0-9A-Fa-f]{0,4}:|[MFSHDPГ]\p{Ll}{1,8}\.? \p{Lu}"
PATTERN = "|".join([_EMAIL, _PHONE, _IP, _IP6, _CARD, _NAME])

#: Letters by script and case; a letter outside of them becomes one of the first row of its case.
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
LETTERS = [LOWER, UPPER, "àáâäçèéêëíîïñóôöùúûüß", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
SYLLABLES = {
    "latin": ["ba", "co", "di", "fe", "ga", "ho", "ki", "le", "ma", "no", "pi", "re", "sa", "to", "vi", "ze"],
    "cyrillic": ["ба", "ко", "ди", "фе", "га", "хо", "ки", "ле", "ма", "но", "пи", "ре", "са", "то", "ви", "зе"],
    "greek": ["βα", "κο", "δι", "φε", "γα", "θο", "κι", "λε", "μα", "νο", "πι", "ρε", "σα", "το", "βι", "ζε"],
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _byte(stream: Column, i: Column) -> Column:
    """Byte ``i`` (from 0) of a hex stream, as an integer; it is read as a ring."""
    return F.conv(F.substring(stream, (i * 2) % F.length(stream) + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: str, value: Column, draw: Column) -> Column:
    """256 keyed pseudo-random bytes for a value, as hex."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(f"{key}\x1f{kind}\x1f{n}"), draw.cast("string"), value), 512) for n in range(4)]
    return F.concat(*parts)


def _chars(value: Column) -> Column:
    return F.split(value, "")


def _recast(value: Column, stream: Column) -> Column:
    """Every digit and letter of ``value`` becomes another of its kind; other characters stay."""

    def one(c: Column, i: Column, s: Column) -> Column:
        b = _byte(s, i)
        out = F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
        for row in LETTERS:
            out = out.when(F.instr(F.lit(row), c) > 0, F.substring(F.lit(row), b % len(row) + 1, F.lit(1)))
        out = out.when(c.rlike(r"\p{Lu}"), F.substring(F.lit(UPPER), b % 26 + 1, F.lit(1)))
        out = out.when(c.rlike(r"\p{L}"), F.substring(F.lit(LOWER), b % 26 + 1, F.lit(1)))
        return out.otherwise(c)

    return _let(stream, lambda s: F.array_join(F.transform(_chars(value), lambda c, i: one(c, i, s)), ""))


def _email(value: Column, key: str, draw: Column) -> Column:
    """Local part and domain are drawn apart, so addresses of one domain keep sharing one."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    new_host = _recast(host, _stream(key, "domain", F.lower(domain), F.lit(0)))
    return F.concat(_recast(local, _stream(key, "local", F.lower(value), draw)), F.lit("@"), new_host, F.lit("."), top)


def _phone(value: Column, key: str, draw: Column) -> Column:
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-]))?", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    # One stream for a number however it is written, read from its last digit.
    later = lambda i: F.length(F.regexp_replace(F.substring(rest, i + 2, F.length(rest)), "[^0-9]", ""))
    one = lambda c, i, s: F.when(c.rlike("[0-9]"), (_byte(s, later(i)) % 10).cast("string")).otherwise(c)
    stream = _stream(key, "phone", F.regexp_replace(value, "[^0-9]", ""), draw)
    return F.concat(code, _let(stream, lambda s: F.array_join(F.transform(_chars(rest), lambda c, i: one(c, i, s)), "")))


def _ip(value: Column, key: str, draw: Column) -> Column:
    return _let(_stream(key, "ip", value, draw), lambda s: _ip_from(value, s))


def _ip_from(value: Column, s: Column) -> Column:
    kept = (
        F.when(value.startswith("10."), 1).when(value.startswith("127."), 1).when(value.startswith("192.168."), 2)
        .when(value.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), 2).otherwise(0)
    )
    octet = lambda x, i: F.when(i < kept, x).otherwise((_byte(s, i) % 223 + 1).cast("string"))
    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _ip6(value: Column, key: str, draw: Column) -> Column:
    """Hex digits become hex digits, of the same case; the first group of a link-local or private address stays."""

    def one(c: Column, i: Column, s: Column, kept: Column) -> Column:
        new = F.lower(F.hex(_byte(s, i) % 16))
        return F.when((i < kept) | (c == ":"), c).when(c.rlike("[A-F]"), F.upper(new)).otherwise(new)

    kept = F.when(value.rlike("(?i)^(fe80|f[cd]..):"), 4).otherwise(0)
    return _let(_stream(key, "ip6", value, draw), lambda s: F.array_join(F.transform(_chars(value), lambda c, i: one(c, i, s, kept)), ""))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last of them a check digit."""
    n = F.size(digits)

    def weigh(d: Column, i: Column) -> Column:
        x = d.cast("int")
        double = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return F.when((n - i) % 2 == 0, double).otherwise(x)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str, draw: Column) -> Column:
    return _let(_stream(key, "card", F.regexp_replace(value, "[ -]", ""), draw), lambda s: _card_from(value, s))


def _card_from(value: Column, s: Column) -> Column:
    digits = _chars(F.regexp_replace(value, "[ -]", ""))
    body = F.transform(F.slice(digits, 2, F.size(digits) - 2), lambda _, i: (_byte(s, i) % 10).cast("string"))
    return _card_of(value, digits, body, _byte(s, F.lit(63)) % 9)


def _card_of(value: Column, digits: Column, body: Column, off: Column) -> Column:
    head = F.concat(F.slice(digits, 1, 1), body)
    short = _luhn_sum(F.concat(head, F.array(F.lit("0")))) % 10
    fit = (F.lit(10) - short) % 10
    unfit = (fit + 1 + off) % 10
    last = F.when(_luhn_sum(digits) % 10 == 0, fit).otherwise(unfit).cast("string")
    new = F.concat(head, F.array(last))
    nth = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.rlike("[0-9]"), F.element_at(new, nth(i))).otherwise(c)), "")


def _name_part(part: Column, role: str, female: Column, key: str, draw: Column) -> Column:
    return _let(_stream(key, role, part, draw), lambda s: _name_part_from(part, role, female, s, draw))


def _name_part_from(part: Column, role: str, female: Column, s: Column, draw: Column) -> Column:
    """Syllables, and with each draw one more, so that names never run out, however many there are."""
    least = 3 if role == "given" else 4

    def build(script: str, endings: tuple[str, str]) -> Column:
        rows = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        spoken = F.transform(F.sequence(F.lit(0), draw + (least - 1)), lambda i: F.element_at(rows, _byte(s, i) % 16 + 1))
        end = F.when(female, endings[0]).otherwise(endings[1]) if role == "given" else F.lit("")
        return F.initcap(F.concat(F.array_join(spoken, ""), end))

    latin, cyrillic, greek = build("latin", ("na", "ro")), build("cyrillic", ("на", "ро")), build("greek", ("να", "ρο"))
    return F.when(part.rlike(r"\p{IsCyrillic}"), cyrillic).when(part.rlike(r"\p{IsGreek}"), greek).otherwise(latin)


def _name(value: Column, key: str, draw: Column) -> Column:
    return _composed_name(value, F.transform(_name_units(value), lambda u: _part_surrogate(u, key, draw)), key)


def kind_of(entity: Column) -> Column:
    """email, ip, ip6, card, phone or name, told from the form of a detected entity; number for a run of digits that is no card."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(entity.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6")
        .when(entity.rlike(r"^\d") & ((F.length(digits) == 16) | ((F.length(digits) > 12) & (_luhn_sum(_chars(digits)) % 10 == 0))), "card")
        .when(entity.rlike(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$|^0\d{2,4}[ -]"), "phone")
        .when(entity.rlike(r"^\d"), "number")
        .otherwise("name")
    )


#: A unit of a name is its role, this sign and the part itself. Roles of given names tell the gender.
_ROLE = "\x1f"


def _tokens(name: Column) -> Column:
    """What follows the honorific, cut into words and the signs between them."""
    body = F.substring(name, F.locate(" ", name) + 1, F.length(name))
    return F.split(body, r"(?<=[ '’-])|(?=[ '’-])", -1)


def _is_word(token: Column) -> Column:
    return token.rlike(r"^\p{L}{2,}$")


def _plain_case(word: Column) -> Column:
    """Words in capitals are the same as others."""
    return F.when(word == F.upper(word), F.initcap(word)).otherwise(word)


def _name_units(name: Column) -> Column:
    given = F.when(_is_female(name), f"given-f{_ROLE}").otherwise(f"given-m{_ROLE}")

    def units(tokens: Column) -> Column:
        last = F.size(tokens) - F.array_position(F.reverse(tokens), " ") + 1  # the place of the last space, or behind all
        first = F.when(F.array_contains(tokens, " "), last).otherwise(0)
        named = F.transform(tokens, lambda t, i: F.when(_is_word(t), F.concat(F.when(i >= first, F.lit(f"surname{_ROLE}")).otherwise(given), _plain_case(t))))
        return F.filter(named, lambda u: u.isNotNull())

    return _let(_tokens(name), units)


def units_of(entity: Column) -> Column:
    """What is held apart: the parts of a name, each with its role, or the entity itself."""
    return F.when(kind_of(entity) == "name", _name_units(entity)).otherwise(F.array(entity))


def _is_female(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, " ", 1), r"\.", "").isin(*FEMALE)


def _is_part(unit: Column) -> Column:
    return unit.contains(_ROLE)


def _composed_name(name: Column, units: Column, key: str) -> Column:
    """The honorific, then words out of ``units`` in order; signs stay, and so does a letter before an apostrophe."""

    def put(tokens: Column, known: Column) -> Column:
        nth = lambda i: F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), _is_word))
        word = lambda i: F.substring_index(F.element_at(known, nth(i)), _ROLE, -1)
        cased = lambda t, i: _let(word(i), lambda w: F.when(t == F.upper(t), F.upper(w)).otherwise(w))
        initial = lambda t: _recast(t, _stream(key, "initial", name, F.lit(0)))
        one = lambda t, i: F.when(_is_word(t), cased(t, i)).when(t.rlike(r"^\p{L}\.$"), initial(t)).otherwise(t)
        return F.array_join(F.transform(tokens, one), "")

    body = _let(units, lambda known: _let(_tokens(name), lambda tokens: put(tokens, known)))
    return F.concat(F.substring_index(name, " ", 1), F.lit(" "), body)


def composed(entity: Column, units: Column, key: str) -> Column:
    """The surrogate of an entity from those of its units."""
    return F.when(kind_of(entity) == "name", _composed_name(entity, units, key)).otherwise(F.element_at(units, 1))


def _part_surrogate(unit: Column, key: str, draw: Column) -> Column:
    part, female = F.substring_index(unit, _ROLE, -1), unit.startswith("given-f")
    new = F.when(unit.startswith("surname"), _name_part(part, "surname", female, key, draw)).otherwise(_name_part(part, "given", female, key, draw))
    return F.concat(F.substring_index(unit, _ROLE, 1), F.lit(_ROLE), new)


def surrogate(unit: Column, key: str, draw: Column | None = None) -> Column:
    """The keyed replacement of a unit; ``draw`` above 0 gives other ones. A whole name is replaced part by part."""
    draw = F.lit(0) if draw is None else draw
    kind = kind_of(unit)
    return (
        F.when(_is_part(unit), _part_surrogate(unit, key, draw))
        .when(kind == "email", _email(unit, key, draw))
        .when(kind == "ip", _ip(unit, key, draw))
        .when(kind == "ip6", _ip6(unit, key, draw))
        .when(kind == "card", _card(unit, key, draw))
        .when(kind == "phone", _phone(unit, key, draw))
        .when(kind == "number", unit)
        .otherwise(_name(unit, key, draw))
    )


def entities_in(text: Column) -> Column:
    """All entities of a text in order; an empty array for a null text."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def _counted(value: Column, n: Column, spare: str) -> Column:
    """Value ``n`` of the form of ``value``: its digits and letters are counted through, the last one fastest.

    What is left of ``n`` when all of them are used up goes before them, in places of ``spare``.
    """
    rows = ["0123456789", *LETTERS]

    def row_of(c: Column) -> Column:
        out = F.when(c == "", F.lit(None).cast("string"))
        for row in rows:
            out = out.when(F.instr(F.lit(row), c) > 0, F.lit(row))
        return out.when(c.rlike(r"\p{Lu}"), F.lit(UPPER)).when(c.rlike(r"\p{L}"), F.lit(LOWER))

    def put(acc: Column, c: Column) -> Column:
        row, left, out = row_of(c), acc["left"], acc["out"]
        size = F.length(row)
        place = F.substring(row, (left % size).cast("int") + 1, F.lit(1))
        moved = F.struct(F.floor(left / size).alias("left"), F.concat(place, out).alias("out"))
        return F.when(row.isNull(), F.struct(left.alias("left"), F.concat(c, out).alias("out"))).otherwise(moved)

    def more(acc: Column, _: Column) -> Column:
        left = acc["left"] - 1
        place = F.substring(F.lit(spare), (left % len(spare)).cast("int") + 1, F.lit(1))
        grown = F.struct(F.floor(left / len(spare)).alias("left"), F.concat(place, acc["out"]).alias("out"))
        return F.when(acc["left"] > 0, grown).otherwise(acc)

    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    used = F.aggregate(F.reverse(_chars(value)), start, put)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), used, more)["out"]


def _address(n: Column, octets: int) -> Column:
    """The last octets of the ``n``-th address of a block."""
    return F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("string") for k in range(octets - 1, -1, -1)])


def numbered_value(entity: Column, key: str, n: Column) -> Column:
    """Value ``n`` (from 0) of the form of a unit. Where a form is used up, names, local parts and phone numbers
    grow longer, and addresses go on in 10.0.0.0/8 and then in the reserved 240.0.0.0/4."""
    local, new = F.substring_index(entity, "@", 1), F.substring_index(_email(entity, key, F.lit(0)), "@", -1)
    email = F.concat(_counted(local, n, LOWER), F.lit("@"), new)
    code = F.regexp_extract(entity, r"^(\+\d{1,3}(?=[ .(-]))?", 1)
    phone = _counted(F.reverse(F.substring(entity, F.length(code) + 1, F.length(entity))), n, "0123456789")
    phone = F.concat(code, F.reverse(phone))

    def beyond(past: int) -> Column:
        m = n - past
        ten = F.concat(F.lit("10."), _address(m, 3))
        top = (F.floor((m - (1 << 24)) / (1 << 24)) + 240).cast("string")
        return F.when(m < 1 << 24, ten).otherwise(F.concat_ws(".", top, _address(m, 3)))

    two = F.when(n < 1 << 16, F.concat(F.substring_index(entity, ".", 2), F.lit("."), _address(n, 2))).otherwise(beyond(1 << 16))
    local_net = F.when(n < 1 << 24, F.concat(F.lit("127."), _address(n, 3))).otherwise(beyond(1 << 24))
    public = F.concat_ws(".", (F.floor(n / (1 << 24)) + 128).cast("string"), _address(n, 3))
    ip = (
        F.when(entity.startswith("10."), beyond(0)).when(entity.startswith("127."), local_net)
        .when(entity.startswith("192.168.") | entity.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), two).otherwise(public)
    )
    digits = _chars(F.regexp_replace(entity, "[ -]", ""))
    card = _card_of(entity, digits, _chars(F.lpad(n.cast("string"), F.size(digits) - 2, F.lit("0"))), F.lit(0))
    ip6 = _hex_counted(entity, n)
    hexed = F.hex(n)
    places = lambda least: _chars(F.when(F.length(hexed) < least, F.lpad(hexed, least, "0")).otherwise(hexed))
    part, role = F.substring_index(entity, _ROLE, -1), F.concat(F.substring_index(entity, _ROLE, 1), F.lit(_ROLE))

    def spoken(script: str, endings: tuple[str, str]) -> Column:
        rows = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        said = lambda least: F.array_join(F.transform(places(least), lambda c: F.element_at(rows, F.conv(c, 16, 10).cast("int") + 1)), "")
        given = F.concat(said(3), F.when(entity.startswith("given-f"), endings[0]).otherwise(endings[1]))
        return F.initcap(F.when(entity.startswith("surname"), said(4)).otherwise(given))

    name = F.when(part.rlike(r"\p{IsCyrillic}"), spoken("cyrillic", ("на", "ро"))).when(part.rlike(r"\p{IsGreek}"), spoken("greek", ("να", "ρο")))
    name = F.concat(role, name.otherwise(spoken("latin", ("na", "ro"))))
    kind = kind_of(entity)
    by_kind = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card)
    return F.when(_is_part(entity), name).otherwise(by_kind.otherwise(phone))


def _hex_counted(value: Column, n: Column) -> Column:
    """Value ``n`` of the form of an IPv6 address: its hex digits are counted through, but for the first group."""

    def put(acc: Column, c: Column) -> Column:
        digit = F.lower(F.hex(acc["left"] % 16))
        moved = F.struct(F.floor(acc["left"] / 16).alias("left"), F.concat(digit, acc["out"]).alias("out"))
        return F.when(c == ":", F.struct(acc["left"].alias("left"), F.concat(c, acc["out"]).alias("out"))).otherwise(moved)

    first = F.substring_index(value, ":", 1)
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    return F.concat(first, F.aggregate(F.reverse(_chars(F.substring(value, F.length(first) + 1, F.length(value)))), start, put)["out"])


def ranked(stuck: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """entity, surrogate for every one of ``stuck`` (entity): free values of its form, that aren't ``taken`` (surrogate)."""
    rest = cut(stuck.select("entity", numbered_value(F.col("entity"), key, F.lit(0).cast("long")).alias("form")))
    placed, width = None, 2
    while rest.limit(1).count():
        # Each form's first values, some times as many as are needed; more of them where too few are free.
        forms = rest.groupBy("form").agg(F.min("entity").alias("sample"), F.count(F.lit(1)).alias("many"))
        values = forms.select("form", "sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") * width + 63)).alias("n"))
        values = values.select("form", "n", numbered_value(F.col("sample"), key, F.col("n")).alias("surrogate"))
        used = taken if placed is None else taken.unionByName(placed.select("surrogate"))
        free = cut(values.groupBy("surrogate").agg(F.min(F.struct("form", "n")).alias("f")).join(used, "surrogate", "left_anti").select("f.form", "f.n", "surrogate"))
        free = free.withColumn("rank", F.row_number().over(Window.partitionBy("form").orderBy("n"))).drop("n")
        waiting = rest.withColumn("rank", F.row_number().over(Window.partitionBy("form").orderBy("entity")))
        met = cut(waiting.join(free, ["form", "rank"], "left").select("entity", "form", "surrogate"))
        found = met.filter("surrogate IS NOT NULL").select("entity", "surrogate")
        placed = found if placed is None else placed.unionByName(found)
        rest, width = met.filter("surrogate IS NULL").select("entity", "form"), width * 4
    return placed


def redrawn(entities: DataFrame, key: str) -> DataFrame:
    """entity, surrogate for those distinct units (column ``entity``) whose first surrogate isn't free.

    A surrogate is free when no unit equals it and no other unit, earlier in (draw, text) order, has it.
    """
    # Written in as many parts as shuffles have: there are few rows, but each takes long to draw.
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cut(entities.select("entity").distinct().repartition(parts, "entity"))
    # Dealt once more: the few small files of ``known`` would be one task, which draws for all.
    table = cut(known.repartition(parts, "entity").select("entity", F.lit(0).alias("draw"), surrogate(F.col("entity"), key).alias("surrogate")))
    for turn in range(MAX_DRAWS + 1):
        # The first holder of each surrogate keeps it; one row per surrogate, so nothing gathers.
        holder = table.groupBy("surrogate").agg(F.min(F.struct("draw", "entity")).alias("h"))
        real = known.select(F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        judged = (
            table.join(holder, "surrogate").join(real, "surrogate", "left")
            .withColumn("bad", (F.col("h.entity") != F.col("entity")) | F.coalesce(F.col("real"), F.lit(False)))
        )
        if not judged.filter("bad").limit(1).count():
            return table.filter("draw > 0").select("entity", "surrogate")
        if turn == MAX_DRAWS:
            break
        draw = F.col("draw") + F.col("bad").cast("int")
        again = judged.select("entity", draw.alias("draw"), F.when(F.col("bad"), surrogate(F.col("entity"), key, draw)).otherwise(F.col("surrogate")).alias("surrogate"))
        table = cut(again)
    judged = cut(judged.select("entity", "draw", "surrogate", "bad"))
    good = judged.filter("NOT bad")
    taken = good.select("surrogate").unionByName(known.select(F.col("entity").alias("surrogate")))
    return good.filter("draw > 0").select("entity", "surrogate").unionByName(ranked(judged.filter("bad").select("entity"), taken, key))


def redrawn_entities(entities: DataFrame, key: str) -> DataFrame:
    """entity, surrogate for the distinct ``entities`` of which a unit was drawn again."""
    units = cut(entities.select("entity", F.posexplode(units_of(F.col("entity"))).alias("nth", "unit")))
    over = cut(redrawn(units.select(F.col("unit").alias("entity")), key).select(F.col("entity").alias("unit"), F.col("surrogate").alias("new")))
    touched = units.join(over, "unit").select("entity", "nth", "new").groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("nth", "new"))).alias("news"))
    # Few rows, each of which takes long to compose: as many parts as shuffles have, not as their bytes would make.
    touched = touched.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")
    own = F.transform(units_of(F.col("entity")), lambda u, i: F.coalesce(F.element_at(F.col("news"), i), surrogate(u, key)))
    return touched.select("entity", composed(F.col("entity"), own, key).alias("surrogate"))


def _without_bare_names(fragment: Column, names: Column) -> Column:
    """A piece of text between entities, with the parts of the document's names (entity, new) replaced as whole words, in capitals too."""

    def words(e: Column) -> Column:
        both = F.arrays_zip(_tokens(e["entity"]).alias("old"), _tokens(e["new"]).alias("new"))
        own = F.filter(both, lambda p: _is_word(p["old"]))
        loud = F.transform(own, lambda p: F.struct(F.upper(p["old"]).alias("old"), F.upper(p["new"]).alias("new")))
        return F.concat(own, loud)

    pairs = F.flatten(F.transform(names, words))
    whole = lambda p: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), p["old"], F.lit(r"(?![\p{L}\p{N}])"))
    return F.aggregate(pairs, fragment, lambda acc, p: F.regexp_replace(acc, whole(p), p["new"]))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced and ``n_entities`` appended (or replaced).

    ``key`` is a secret: whoever has it can tell which surrogate an entity has. Bare mentions of a name count as part of its entity.
    A null text stays null with 0 entities. Repeated rows and ids are allowed; extra columns stay.
    Empty tables give empty tables.
    """
    if not key:
        raise ValueError("a key is needed")
    found = docs.select(F.col(id_col).alias("id"), F.explode(entities_in(F.col(text))).alias("entity"))
    found = cut(found.filter(kind_of(F.col("entity")) != "number").distinct())
    over = cut(redrawn_entities(found.select("entity").distinct(), key))
    work = docs.withColumn("__llm_entities", entities_in(F.col(text)))
    swap = lambda e: surrogate(e, key)
    if over.limit(1).count():
        by_doc = found.join(over, "entity").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("__llm_over"))
        by_doc = cut(by_doc).withColumnRenamed("id", "__llm_id")
        work = work.join(by_doc, F.col(id_col).eqNullSafe(F.col("__llm_id")), "left").drop("__llm_id")
        swap = lambda e: F.coalesce(F.element_at(F.col("__llm_over"), e), surrogate(e, key))
    kinds = lambda e: F.struct(e.alias("entity"), swap(e).alias("new"), kind_of(e).alias("kind"))
    work = work.withColumn("__llm_swapped", F.transform("__llm_entities", kinds))
    listed = F.col("__llm_swapped")
    names = F.array_distinct(F.filter(listed, lambda e: e["kind"] == "name"))
    parts = F.split(F.col(text), PATTERN, -1)
    parts = F.when(F.exists(listed, lambda e: e["kind"] == "name"), F.transform(parts, lambda p: _without_bare_names(p, names))).otherwise(parts)
    mended = F.array_join(F.zip_with(parts, listed, lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")
    new = F.when(F.size(listed) > 0, mended).otherwise(F.col(text))
    columns = [new.alias(text) if c == text else F.col(c) for c in docs.columns if c != "n_entities"]
    counted = F.size(F.filter(listed, lambda e: e["kind"] != "number"))
    return work.select(*columns, F.when(F.col(text).isNull(), 0).otherwise(counted).cast("long").alias("n_entities"))
