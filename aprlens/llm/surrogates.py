"""Personal data replaced by keyed surrogates, in Spark's own functions.

A surrogate depends on the key, the kind of entity and its canonical form alone, so one entity has one surrogate in all
documents. All entities of the corpus are checked together: where two would share a surrogate, or one would look like
an entity that occurs, all but one are drawn again until none collide. Kind, script, gender and format are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import kept

# Forms of address by gender, surrogate names by script and gender, and name stems for family names.
HONORIFICS = {
    "m": "Mr Herr Señor Monsieur Sir Господин",
    "f": "Mrs Ms Miss Frau Señora Señorita Madame Mme Госпожа",
    "x": "Dr Prof Professor Доктор",
}
GIVEN = {
    "latin m": "Adam Bruno Carl Daniel Edgar Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul Robert Simon Thomas Victor",
    "latin f": "Alice Bella Clara Diana Emma Flora Greta Hanna Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Tessa Vera",
    "latin x": "Alex Robin Kim Sascha Andrea Dominique Camille Jamie Morgan Taylor",
    "cyrillic m": "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег Павел Роман Сергей Тимур Юрий",
    "cyrillic f": "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лариса Мария Нина Ольга Полина София Юлия",
    "cyrillic x": "Саша Женя Валя Слава Шура",
}
STEMS = {
    "latin": "Ander Berg Cald Dorn Ester Falk Grim Hol Ing Jan Kess Lind Mar Nord Ost Pell Rand Stein Tor Wald",
    "cyrillic": "Анд Бел Вол Гор Дуб Зай Кор Лук Мор Ник Орл Пет Рог Сок Тих",
}
ENDINGS = {
    "latin": "sen mann ley ford stad ham wood ton berg quist ard ini ez ova er",
    "cyrillic": "ский енко ович ин ев ко юк",
}
_TITLE = "|".join(h for words in HONORIFICS.values() for h in words.split())
_NAME = r"\p{Lu}[\p{L}'’-]*\p{Ll}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
# International: "+", the country's code as assigned, 6 to 12 further digits. National: ten digits of North America in
# one run, 3-3-4 digits, or a trunk zero and groups set apart by one and the same sign, 9 to 11 digits.
_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_PREFIX = rf"^(?:\+{_CODE}(?:[ .-]?\(0\))?|0(?=\d))?"  # what of a number stays as it is
PHONE = (
    r"(?<![\p{L}\p{N}.+-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    rf"|\+{_CODE}(?:[ .-]?\(0\))?(?=(?:[ .()-]{{0,2}}\d){{6,12}}(?!\d))(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?\d{{2,12}}|[ .-]\d(?=[ .-]\d)){{1,6}}"
    r"|0(?=(?:[ ./-]?\d){8,10}(?![ ./-]?\d))\d{1,4}(?<apart>[ ./-])\d{2,8}(?:\k<apart>\d{2,4}){0,4}"
    r"|[2-9]\d{2}[2-9]\d{6})(?![\p{L}\p{N}])"
)
CARD = r"(?<![\p{L}\p{N}.-])(?:\d{13,19}|\d{4}(?<gap>[ -])(?:\d{4}\k<gap>\d{4}\k<gap>\d{4}|\d{6}\k<gap>\d{4,5}))(?![\p{L}\p{N}])"
ADDRESS = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[\p{{L}}\p{{N}}])"
NUMBER = r"(?<![\p{L}\p{N}.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
# In quotes a value is all up to the closing quote that has no blank, else all up to a blank, a quote or an angle bracket,
# but for closing punctuation. One without any letter or digit is a mask, one that is an email is an email. After a colon
# a plain word of up to 15 letters, written as prose writes it, is prose.
_PROSE = r"\s{0,3}\p{L}[\p{Ll}'’-]{0,14}+[.,;:!?)\]}]*+(?:\s|$)"
ASSIGNED = (
    rf"(?<![\p{{L}}\p{{N}}])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{{0,3}}(?:=|:(?!{_PROSE}))\s{{0,3}}"
    rf"(?![\"']?{EMAIL}(?:[\"'\s]|$))(?=[\"']?[^\s\"'\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])"
    r"(?:\"[^\s\"]{8,}+(?=\")|'[^\s']{8,}+(?=')|[\"']?[^\s\"'<>]{7,}[^\s\"'<>.,:;?)\]}])"
)
# Keys and tokens with a mark of their issuer, what follows "Bearer", and signed web tokens; the mark stays.
_ISSUED = r"(?:AKIA(?=[0-9A-Z]{16}$)|gh[pousr]_|github_pat_|xox[abprs]-|[rs]k_live_|AIza|eyJ|(?i:bearer) )"
ACCESS = (
    r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|xox[abprs]-[0-9A-Za-z-]{10,}"
    r"|[rs]k_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
    r"|(?i:bearer) (?=[^\s]*[0-9])[0-9A-Za-z._~+/-]{20,}+=*)(?![\p{L}\p{N}])"
)
PRIVATE = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[0-9A-Za-z+/=\s:,-]{16,}?-----END (?:[A-Z]+ )*PRIVATE KEY-----"
_PRIVATE_PARTS = r"(?s)^(-----[^-]+-----)(.*)(-----END [^-]+-----)$"
_HEXTET = r"[0-9A-Fa-f]{1,4}"
# In full, or with one run of zeros left out and at least one digit.
ADDRESS6 = (
    rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEXTET}:){{7}}{_HEXTET}"
    rf"|(?=[0-9A-Fa-f:]{{0,38}}[0-9])(?:{_HEXTET}:){{1,6}}(?::{_HEXTET}){{1,6}})(?![\p{{L}}\p{{N}}:])"
)
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4})?)(?![\p{L}\p{N}])"
PERSON = rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?(?!\p{{L}})"
ENTITY = "|".join([EMAIL, ASSIGNED, PRIVATE, ACCESS, IBAN, ADDRESS6, CARD, PHONE, NUMBER, ADDRESS, PERSON])
_WORD = r"\p{L}+(?:['’-](?!s(?!\p{L}))\p{L}+)*"  # without a genitive's ending
HEX = "0123456789abcdef"
LAST_ROUND, WIDER = 200, 24  # rounds of drawing again; from WIDER on surrogates grow by two signs, so they never run out


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is stated and computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def _byte(digest: Column, at: Column) -> Column:
    """Two hex signs of a digest as a number, by a running position."""
    return F.conv(F.substring(digest, F.pmod(at, F.lit(31)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: str, number: Column) -> Column:
    listed = words.split()
    return F.element_at(F.array(*map(F.lit, listed)), F.pmod(number, F.lit(len(listed))).cast("int") + 1)


def _word_number(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 6), 16, 10).cast("long")


def _recast(value: Column, digest: Column) -> Column:
    """Every sign replaced by one of its class: digit, a-f within hex, letter by case and script (a to z
    for letters of other scripts); others stay."""
    return _let(value.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$"), lambda plain_hex: _signs(value, digest, plain_hex))


def _signs(value: Column, digest: Column, plain_hex: Column) -> Column:
    signs = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(plain_hex, F.substring(F.lit(HEX), F.pmod(_byte(digest, i) + i, F.lit(16)) + 1, F.lit(1)))
        .when(c.rlike("[0-9]"), F.pmod(_byte(digest, i), F.lit(10)).cast("string"))
        .when(c.rlike("[a-z]"), F.char(F.pmod(_byte(digest, i), F.lit(26)) + 97))
        .when(c.rlike("[A-Z]"), F.char(F.pmod(_byte(digest, i), F.lit(26)) + 65))
        .when(c.rlike(r"\p{IsCyrillic}"), F.substring(F.lit("абвгдежзиклмнопрстуфхцчшщэюя"), F.pmod(_byte(digest, i), F.lit(28)) + 1, F.lit(1)))
        .when(c.rlike(r"[\p{L}\p{N}]"), F.char(F.pmod(_byte(digest, i), F.lit(26)) + 97))
        .otherwise(c),
    )
    return F.array_join(signs, "")


def _luhn_sum(digits: Column) -> Column:
    """Checksum of a digit string, from its right end."""

    def part(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x)


def _rest_97(text: Column) -> Column:
    """An account number of digits and letters (A is 10) modulo 97."""

    def read(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.pmod(F.when(c.rlike("[A-Z]"), rest * 100 + letter).otherwise(rest * 10 + c.try_cast("int")), F.lit(97))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), read)


def _account(value: Column, digest: Column) -> Column:
    """Country and length kept, check digits made right."""
    country, body = F.substring(value, 1, 2), _recast(F.substring(value, F.lit(5), F.length(value) - 4), digest)
    check = F.lpad((98 - _rest_97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, body)


def _hex_signs(value: Column, digest: Column) -> Column:
    """Hex digits replaced, all other signs kept."""
    signs = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(
            c.rlike("[0-9a-f]"), F.substring(F.lit(HEX), F.pmod(_byte(digest, i) + i, F.lit(16)) + 1, F.lit(1))
        ).otherwise(c),
    )
    return F.array_join(signs, "")


def _card(digits: Column, digest: Column) -> Column:
    """First digit kept, last one the check digit."""
    body = F.concat(F.substring(digits, 1, 1), _recast(F.substring(digits, F.lit(2), F.length(digits) - 2), digest))
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.concat(body, check.cast("string"))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def surrogate(kind: Column, value: Column, draw: Column, key: str) -> Column:
    """The canonical surrogate of a canonical value; ``draw`` counts how often it was drawn again."""
    digest = _hash(F.lit(key), kind, value, draw.cast("string"))
    return _let(digest, lambda d: _surrogate(kind, value, draw, d, key))


def _surrogate(kind: Column, value: Column, draw: Column, digest: Column, key: str) -> Column:
    more = F.when(draw >= WIDER, F.substring(_recast(F.lit("00"), digest), 1, 2)).otherwise(F.lit(""))
    country = F.substring_index(value, " ", 1)
    number = _recast(F.substring_index(value, " ", -1), digest)
    # No part of a number begins with 0 or 1.
    number = F.concat(F.pmod(_byte(digest, F.lit(29)), F.lit(8)).cast("int").cast("string"), F.substring(number, 2, 99))
    number = F.concat(F.translate(F.substring(number, 1, 1), "01", "89"), F.substring(number, 2, 99))
    host = F.lower(F.substring_index(value, "@", -1))
    site = F.concat(F.lit("@d"), F.substring(_hash(F.lit(key), F.lit("host"), host), 1, 10), F.lit(".example.com"))
    octets = [F.pmod(_byte(digest, F.lit(i)), F.lit(254)) + 1 for i in range(4)]
    script = _script(value)
    given = F.lit(None).cast("string")
    for group, words in GIVEN.items():
        s, g = group.split()
        given = F.when((kind == f"given {g}") & (script == s), _pick(words, _word_number(digest, 1))).otherwise(given)
    family = F.lit(None).cast("string")
    for s, stems in STEMS.items():
        made = F.concat(_pick(stems, _word_number(digest, 1)), _pick(ENDINGS[s], _word_number(digest, 9)))
        family = F.when(script == s, made).otherwise(family)
    # Lists of names are short: from the second drawing on a further part is added.
    tail = F.when(script == "cyrillic", F.lower(_pick(STEMS["cyrillic"], _word_number(digest, 17))))
    tail = tail.otherwise(F.lower(_pick(STEMS["latin"], _word_number(digest, 17))))
    letters = F.when(script == "cyrillic", F.lit("ааа")).otherwise(F.lit("aaa"))  # of the value's script
    further = F.when(draw > 1, F.concat(tail, F.when(draw > 3, _recast(letters, digest)).otherwise(F.lit(""))))
    further = F.coalesce(further, F.lit(""))
    return (
        F.when(kind == "email", F.concat(_recast(F.substring_index(value, "@", 1), digest), more, site))
        .when(kind == "phone", F.concat(country, F.lit(" "), number, more))
        .when(kind == "card", F.concat(_card(value, digest), more))
        .when(kind == "number", F.concat(_recast(value, digest), more))
        .when(kind == "address", F.concat(F.concat_ws(".", *[o.cast("string") for o in octets]), F.when(draw >= WIDER, F.concat(F.lit("-"), more)).otherwise(F.lit(""))))
        .when(kind == "access", _let(F.regexp_extract(value, f"^{_ISSUED}", 0), lambda mark: F.concat(mark, _recast(F.substring(value, F.length(mark) + 1, F.length(value)), digest), more)))
        .when(kind == "private", F.concat(_recast(value, digest), more))
        .when(kind == "account", F.concat(_account(value, digest), more))
        .when(kind == "address6", F.concat(_hex_signs(value, digest), F.when(draw >= WIDER, F.concat(F.lit("-"), more)).otherwise(F.lit(""))))
        .when(kind == "secret", F.concat(_recast(value, digest), more))
        .when(kind == "family", F.concat(family, further))
        .otherwise(F.concat(given, further))
    )


def _kind(match: Column) -> Column:
    """The kind of one match of :data:`ENTITY`."""
    return (
        F.when(match.rlike("^(?:" + EMAIL + ")$"), "email")
        .when(match.rlike("^" + ACCESS + "$"), "access")
        .when(match.startswith("-----BEGIN "), "private")
        .when(match.rlike("^" + IBAN + "$"), "account")
        .when(match.rlike("^" + ADDRESS6 + "$"), "address6")
        .when(match.rlike("^" + ADDRESS + "$"), "address")
        .when(match.rlike("^" + NUMBER + "$"), "number")
        .when(match.rlike("^" + CARD + "$"), "card")
        .when(match.rlike("^" + PHONE + "$"), "phone")
        .when(match.rlike("[=:]"), "secret")
        .otherwise("person")
    )


_VALUE = r"(?s)^(.*?[=:]\s*[\"']?)(.*)$"


def _entities(match: Column) -> Column:
    """(kind, value) of each entity in a match, canonical: equal for equal entities however they are written."""
    return _let(_kind(match), lambda kind: _entities_of(match, kind))


def _entities_of(match: Column, kind: Column) -> Column:
    one = lambda k, v: F.array(F.struct(k.alias("kind"), v.alias("value")))
    country = F.coalesce(F.nullif(F.regexp_extract(match, rf"^\+({_CODE})", 1), F.lit("")), F.lit("-"))
    local = _digits(F.regexp_replace(match, _PREFIX, ""))
    words = F.split(match, " ")
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.lit("x")
    for g in ("m", "f"):
        gender = F.when(title.isin(HONORIFICS[g].split()), F.lit(g)).otherwise(gender)
    family = F.struct(F.lit("family").alias("kind"), F.element_at(words, -1).alias("value"))
    given = F.struct(F.concat(F.lit("given "), gender).alias("kind"), F.get(words, F.lit(1)).alias("value"))
    person = F.when(F.size(words) > 2, F.array(given, family)).otherwise(F.array(family))
    account = F.translate(match, " ", "")
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    luhn = F.pmod(_luhn_sum(_digits(match)), F.lit(10)) == 0
    nothing = F.slice(person, 1, 0)
    return (
        F.when(kind == "email", one(kind, F.lower(match)))
        .when(kind == "phone", one(kind, F.concat(country, F.lit(" "), local)))
        .when(kind == "card", F.when(luhn, one(kind, _digits(match))).otherwise(nothing))
        .when(kind == "number", one(kind, _digits(match)))
        .when(kind.isin("address", "access"), one(kind, match))
        .when(kind == "address6", one(kind, F.lower(match)))
        .when(kind == "private", one(kind, F.regexp_extract(match, _PRIVATE_PARTS, 2)))
        .when(kind == "account", F.when(_rest_97(turned) == 1, one(kind, account)).otherwise(nothing))
        .when(kind == "secret", one(kind, F.regexp_extract(match, _VALUE, 2)))
        .otherwise(person)
    )


def _laid(match: Column, digits: Column) -> Column:
    """``digits`` in the places of the match's digits; surplus ones at the end."""
    signs = F.transform(
        F.split(match, ""),
        lambda c, i: F.when(
            c.rlike("[0-9]"),
            F.substring(digits, F.length(_digits(F.substring(match, F.lit(1), i + 1))), F.lit(1)),
        ).otherwise(c),
    )
    return F.concat(F.array_join(signs, ""), F.substring(digits, F.length(_digits(match)) + 1, F.lit(9)))


def _replaced(match: Column, redrawn: Column, key: str) -> Column:
    """The text that takes the place of a match. ``redrawn``: how often "kind value" was drawn again, if it was."""

    def to(entity: Column) -> Column:
        kind, value = entity["kind"], entity["value"]
        draw = F.coalesce(F.try_element_at(redrawn, F.concat_ws(" ", kind, value)), F.lit(0))
        return surrogate(kind, value, draw, key)

    def text(found: Column, made: Column) -> Column:
        kind, first = F.get(found, F.lit(0))["kind"], F.get(made, F.lit(0))
        title = F.concat(F.substring_index(match, " ", 1), F.lit(" "))
        country = F.when(kind == "phone", F.regexp_extract(match, _PREFIX, 0)).otherwise(F.lit(""))
        local = F.substring(match, F.length(country) + 1, F.length(match))
        digits = F.when(kind == "phone", F.substring_index(first, " ", -1)).otherwise(first)
        return (
            F.when(F.size(found) == 0, match)
            .when(kind.isin("phone", "card", "number"), F.concat(country, _laid(local, digits)))
            .when(kind == "secret", F.concat(F.regexp_extract(match, _VALUE, 1), first))
            .when(kind == "private", F.concat(F.regexp_extract(match, _PRIVATE_PARTS, 1), first, F.regexp_extract(match, _PRIVATE_PARTS, 3)))
            .when((kind == "account") & match.contains(" "), F.regexp_replace(first, "(.{4})(?=.)", "$1 "))
            .when(kind == "family", F.concat(title, first))
            .when(F.size(found) == 2, F.concat(title, first, F.lit(" "), F.get(made, F.lit(1))))
            .otherwise(first)
        )

    return _let(_entities(match), lambda found: _let(F.transform(found, to), lambda made: text(found, made)))


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value``, ``draw``, ``made`` of all distinct entities, no two of a kind with one surrogate and none
    that is itself an entity.

    A surrogate that clashes with none is settled and only looked up from then on; a round draws the others again.
    """
    taken = entities.select("kind", F.col("value").alias("made"))
    open_ones, settled = entities, None
    for draw in range(LAST_ROUND):
        made = surrogate(F.col("kind"), F.col("value"), F.lit(draw), key)
        drawn = kept(open_ones.select("kind", "value", F.lit(draw).alias("draw"), made.alias("made")), "drawn")
        held = taken if settled is None else taken.unionByName(settled.select("kind", "made"))
        free = drawn.join(held, ["kind", "made"], "left_anti")
        first = free.groupBy("kind", "made").agg(F.min("value").alias("value"))
        won = kept(first.select("kind", "value", F.lit(draw).alias("draw"), "made"), "settled")
        settled = won if settled is None else settled.unionByName(won)
        open_ones = kept(drawn.select("kind", "value").join(won, ["kind", "value"], "left_anti"), "clashes")
        if open_ones.isEmpty():
            return settled
    raise RuntimeError("surrogates still collide")


def _told_again(gap: Column, names: Column, surrogates: Column) -> Column:
    """``gap`` with the words that are among ``names`` replaced, and how many were."""

    def swapped(word: Column) -> Column:
        at = F.array_position(names, word).cast("int")
        return F.when(at > 0, F.get(surrogates, at - 1)).otherwise(word)

    def told(words: Column) -> Column:
        rest = F.split(gap, _WORD, -1)
        woven = F.zip_with(rest, F.transform(words, swapped), lambda r, new: F.concat(r, F.coalesce(new, F.lit(""))))
        hits = F.size(F.filter(words, lambda w: F.array_contains(names, w)))
        return F.struct(F.array_join(woven, "").alias("text"), hits.cast("long").alias("n"))

    return _let(F.regexp_extract_all(gap, F.lit(_WORD), F.lit(0)), told)


def with_surrogates(docs: DataFrame, key: str = "corpus") -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_entities``: how many entities were replaced.

    Emails, phone, card and account numbers (IBAN; both with right check digits), identity numbers, IPv4 and IPv6 addresses,
    assigned secrets, keys and tokens with their issuer's mark or after "Bearer", private keys, and names after a form of
    address are found; where such a name stands alone in the same text, as it is written there, it is replaced, too, by the
    same surrogate. Left out are phone numbers after 00, without "+", trunk zero or 3-3-4
    digits outside North America and with extensions, card numbers in other groups than 4-4-4-4, 4-6-5 and 4-6-4,
    assigned secrets of fewer than eight signs, those with blanks, what follows a quote or angle bracket inside one, plain
    words of up to 15 letters after a colon, and secrets that neither key word nor mark names. Null texts stay null, texts without entities stay as they are, repeated
    rows and null ids are kept, columns other than ``text`` are carried whatever their names (those that begin with
    two underscores are reserved, ``n_entities`` is replaced), and an empty table gives an empty result.
    """
    matches = F.regexp_extract_all(F.col("text"), F.lit(ENTITY), F.lit(0))
    listed = docs.select(F.col("doc_id").alias("__doc"), F.explode(matches).alias("__match"))
    listed = listed.select("__doc", F.explode(_entities(F.col("__match"))).alias("__e"))
    listed = kept(listed.select("__doc", F.col("__e.kind").alias("kind"), F.col("__e.value").alias("value")).distinct(), "entities")
    settled = _settled(kept(listed.select("kind", "value").distinct(), "distinct"), key)
    again = settled.where("draw > 0").select("kind", "value", "draw")
    # Only documents with an entity drawn again need to be told; Spark broadcasts that table while it is small.
    pairs = F.struct(F.concat_ws(" ", "kind", "value"), "draw")
    told = listed.join(again, ["kind", "value"]).groupBy("__doc").agg(F.map_from_entries(F.collect_list(pairs)).alias("__again"))
    told = kept(told.withColumnRenamed("__doc", "__told"), "told")
    rows = docs.join(told, F.col("doc_id").eqNullSafe(F.col("__told")), "left")
    # Texts without a match are not searched a second time.
    between = F.when(F.size("__found") > 0, F.split(F.col("text"), ENTITY, -1))
    rows = rows.withColumn("__found", matches).withColumn("__gaps", between)
    is_name = lambda e: e["kind"].rlike("^(family|given)")
    persons = F.filter("__found", lambda m: _kind(m) == "person")
    names = F.array_distinct(F.filter(F.flatten(F.transform(persons, _entities)), is_name))
    rows = rows.withColumn("__names", F.when(F.size(persons) > 0, names))

    def drawn_for(entity: Column) -> Column:
        draw = F.coalesce(F.try_element_at(F.col("__again"), F.concat_ws(" ", entity["kind"], entity["value"])), F.lit(0))
        return surrogate(entity["kind"], entity["value"], draw, key)

    rows = rows.withColumn("__shown", F.transform("__names", drawn_for)).withColumn("__names", F.col("__names.value"))
    plain = F.transform("__gaps", lambda gap: F.struct(gap.alias("text"), F.lit(0).cast("long").alias("n")))
    told = F.transform("__gaps", lambda gap: _told_again(gap, F.col("__names"), F.col("__shown")))
    rows = rows.withColumn("__gaps", F.when(F.size("__names") > 0, told).otherwise(plain))
    swapped = F.transform("__found", lambda m: _replaced(m, F.col("__again"), key))
    woven = F.zip_with(F.col("__gaps.text"), swapped, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    number = F.aggregate("__found", F.lit(0).cast("long"), lambda n, m: n + F.size(_entities(m)))
    number = number + F.aggregate("__gaps", F.lit(0).cast("long"), lambda n, gap: n + gap["n"])
    rows = rows.withColumn("text", F.when(F.size("__found") > 0, F.array_join(woven, "")).otherwise(F.col("text")))
    return rows.withColumn("n_entities", F.coalesce(number, F.lit(0))).select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "n_entities"], "n_entities"
    )
