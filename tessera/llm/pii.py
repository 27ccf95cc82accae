"""Keyed surrogates for personal data, in DataFrame functions only.

What is found, by one pattern: e-mail addresses (in any script), IPv4 and IPv6 addresses,
phone, card and social security numbers, IBANs (also in groups of four), access keys and web
tokens by their prefixes, values given to a key, token, secret or password, hexadecimal
strings of 32 and more, and names. Names are listed given names and surnames, in capitals
too, with the capitalised word after a given name; capitalised words after a title; and
Chinese names of a listed surname and one or two further characters that stand by
themselves and are no listed common word. The capitalised words of a text's names count as
names in all of that text, unless they occur in it in lower case too. Other names (a surname alone that is not
listed, names in lower case) are not found. NAMES may be replaced by longer lists, `names` in the functions below.

A surrogate is a keyed permutation of its entity: letters and digits are shifted within their
class (case and script stay, and so does punctuation), each by a hash of the others, in
Feistel rounds. So equal entities get equal surrogates everywhere, also when written with
other separators or in other case, distinct ones get distinct ones, and no table has to be
joined: the work is one projection over the texts. Card numbers keep their first digit
and whether their check digit is right; addresses keep four octets or their groups;
hexadecimal strings stay hexadecimal; e-mail addresses keep their top-level domain; tokens
their prefix; listed names go to another listed name of their gender and script, and no other
name goes to a listed one: where the permutation would do so it is applied again. Vowels of names stay vowels.

collisions() checks on the data that no two entities of a type share a surrogate: one
aggregation of what was replaced. Should two share one all the same, checked() works out all
surrogates again under a key that follows from the key.

Null and empty texts stay as they are and have no entities; so does every text without
entities, byte for byte. Very long texts are read whole; repeated rows get the same
surrogates; an empty table gives an empty result. Other columns are kept, whatever their
names, but for count_col; ids may repeat or be null.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored

#: Names that are found and stand in for each other, by gender and script. Those of under five
#: letters count as names only before a capitalised word.
NAMES: dict[str, tuple[str, ...]] = {
    "female latin": ("Elizabeth", "Katharina", "Charlotte", "Margarita", "Françoise", "Jennifer", "Isabella", "Patricia", "Giovanna", "Brigitte", "Dolores", "Michelle", "Maria", "Anna", "Laura", "Sophie", "Emily", "Sarah"),
    "male latin": ("Alexander", "Christopher", "Sebastián", "Wolfgang", "Guillaume", "Benjamin", "Francesco", "Santiago", "Friedrich", "Matthew", "Jonathan", "Philippe", "James", "John", "Robert", "Michael", "David", "Thomas", "Pierre", "Carlos"),
    "surname latin": ("Johnson", "Williams", "Schneider", "Rodríguez", "Fernández", "Lefebvre", "Hoffmann", "Thompson", "Bernard", "Zimmermann", "Martínez", "García", "Müller", "Schmidt", "Dubois"),
    "female cyrillic": ("Екатерина", "Анастасия", "Светлана", "Людмила", "Татьяна", "Анна", "Мария", "Ольга", "Наталья"),
    "male cyrillic": ("Александр", "Владимир", "Дмитрий", "Николай", "Сергей", "Иван", "Андрей", "Михаил"),
    "female surname cyrillic": ("Иванова", "Петрова", "Смирнова", "Кузнецова", "Соколова"),
    "male surname cyrillic": ("Иванов", "Петров", "Смирнов", "Кузнецов", "Соколов"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Signor", "Signora")
#: Chinese surnames, and characters of given names.
SURNAMES_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
GIVEN_HAN = "伟芳娜敏静丽强磊军洋勇艳杰涛明超秀霞平刚桂英华玉萍红玲芬燕建国文志海波"
#: Common words that begin with such a surname.
WORDS_HAN = ("高兴", "高度", "高级", "高等", "高速", "高中", "高原", "高山", "马上", "马路", "王国", "王子", "王后", "黄金", "黄色", "黄河", "周围", "周末", "周年", "周期", "张开", "何时", "何处", "何必", "林业", "陈述", "陈列", "杨树", "李子", "孙子", "孙女", "徐徐", "朱红", "胡说", "胡同", "罗列", "赵国")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX4 = "[0-9A-Fa-f]{1,4}"
_PREFIX = "AKIA|gh[pousr]_|github_pat_|[spr]k_(?:live|test)_|xox[abprs]-|AIza|eyJ"
#: Type and pattern, in order of precedence. Patterns start only where a run of their characters does.
PATTERNS = (
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)*+(?<=\.\p{L}{2,63})"),
    ("ipv4", rf"(?<![0-9.vV])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("ipv6", rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{{0,9}}[0-9])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}}|(?:{_HEX4}:){{2,7}}:)(?![0-9A-Za-z:])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z.,/+-])0[1-9][0-9]{1,3}[ /-][0-9]{5,9}(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ssn", r"(?<=(?i:ssn|social security|social security number)[ :#]{1,3})[0-9]{9}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("key", r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255}|[spr]k_(?:live|test)_[A-Za-z0-9]{10,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{5,2000}\.[A-Za-z0-9_-]{5,4000}\.[A-Za-z0-9_-]{5,2000})(?![A-Za-z0-9_])"),
    ("hex", r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"),
    ("secret", r"(?<=[=:][\s\"']{0,4})(?<=(?i:key|token|secret|password|passwd|pwd)[\"']{0,1}\s{0,2}[=:]\s{0,2}[\"']{0,1})(?=[^0-9\s]{0,99}[0-9])[^\s\"',;]{6,200}"),
)
_DATA = "|".join(p for _, p in PATTERNS)
#: A text without any of these, and without digits or @, holds names at most.
_HINTS = ("AKIA", "AIza", "eyJ", "xox", "_pat_", "_live_", "_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


def _hinted(text: Column) -> Column:
    out = text.rlike("[0-9@]")
    for hint in _HINTS:
        out = out | text.contains(hint)
    return out


def _trie(words: Sequence[str]) -> str:
    """One of the words, as a pattern that shares their beginnings."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words), reverse=True):
        by.setdefault(w[:1], []).append(w[1:])
    branches = [letter + _trie(rest) if letter else "" for letter, rest in by.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def name_pattern(names: Mapping[str, Sequence[str]] = NAMES) -> str:
    both = lambda words: [x for w in words for x in (w, w.upper())]
    given = [n for kind, s in names.items() if "surname" not in kind for n in s]
    surnames = [n for kind, s in names.items() if "surname" in kind for n in s]
    # a word after a given name is part of it, not the first one of the next sentence
    word = r"\p{Lu}\p{L}{1,30}"
    # cheap conditions come first, as every place of a text is tried
    return (
        rf"(?<!\p{{L}})(?:(?=\p{{Lu}})(?:(?:{_trie(both(given))} {word}|{_trie(both(n for n in given + surnames if len(n) > 4))})"
        rf"|(?<= )(?<=(?<!\p{{L}})(?:{'|'.join(TITLES)})\.{{0,1}} ){word}(?: {word}){{0,2}})"
        rf"|(?!(?:{'|'.join(WORDS_HAN)})(?!\p{{L}}))[{SURNAMES_HAN}]\p{{IsHan}}{{1,2}})(?!\p{{L}})"
    )


#: Letters that may stand for each other.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    SURNAMES_HAN,
    GIVEN_HAN,
)
HEX = ("0123456789abcdef",)
#: Letters of names that may stand for each other: vowels for vowels.
NAME_ALPHABETS = (
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "AEIOU",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûü",
    "çðñþý",
    "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ",
    "ÇÐÑÞÝ",
    "аеиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "АЕИОУЫЭЮЯ",
    "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    SURNAMES_HAN,
    GIVEN_HAN,
)
#: First and last of the Han characters that are shifted among those not in the lists above.
HAN = (0x4E00, 0x9FA5)


def session_key(spark: SparkSession) -> str:
    """The key that the session's spark.tessera.surrogateKey names; a random one, kept there, where it names none."""
    name = "spark.tessera.surrogateKey"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(16))
    return spark.conf.get(name)


def _shift(c: Column, k: Column, alphabets: Sequence[str]) -> Column:
    """The character k places on in its alphabet."""
    out = c
    for letters in alphabets:
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.substring(F.lit(letters), ((at - 1 + k) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _shift_name(c: Column, k: Column, alphabets: Sequence[str]) -> Column:
    """_shift(), for the other Han characters too: by their number among those that are not listed."""
    listed = sorted(map(ord, set(SURNAMES_HAN + GIVEN_HAN)))
    n = HAN[1] - HAN[0] + 1 - len(listed)
    code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")

    def moved(code: Column) -> Column:
        place = code - HAN[0] - F.size(F.filter(F.array(*map(F.lit, listed)), lambda x: x < code))
        to = F.aggregate(F.array(*map(F.lit, listed)), (place + k) % n + HAN[0], lambda at, x: F.when(at >= x, at + 1).otherwise(at))
        return F.decode(F.unhex(F.lpad(F.hex(to), 4, "0")), "UTF-16BE")

    other = c.rlike(rf"^[\u{HAN[0]:04X}-\u{HAN[1]:04X}]$") & ~c.rlike(f"[{SURNAMES_HAN}{GIVEN_HAN}]")
    return F.when(other, _let(code, moved)).otherwise(_shift(c, k, alphabets))


def _hash(key: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, *parts), 256)


def _permuted(text: Column, key: Column, tag: Column, alphabets: Sequence[str] = ALPHABETS, shift=_shift) -> Column:
    """A text of letters and digits under the keyed permutation of its shape; case does not matter to it."""

    def turn(chars: Column, r: Column) -> Column:
        rest = F.lower(F.array_join(F.filter(chars, lambda c, i: (i + r) % 2 == 1), ""))
        by = lambda rest, i: F.conv(F.substring(_hash(key, tag, r.cast("string"), i.cast("string"), rest), F.lit(1), F.lit(7)), 16, 10).cast("int")
        return _let(rest, lambda rest: F.transform(chars, lambda c, i: F.when((i + r) % 2 == 0, shift(c, by(rest, i), alphabets)).otherwise(c)))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.split(text, ""), turn), "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9\p{L}]", "")


def _dressed(bare: Column, shape: Column) -> Column:
    """bare's characters in the places of shape's letters and digits, its punctuation kept."""
    put = lambda bare: F.array_join(
        F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike(r"[0-9\p{L}]"), F.substring(bare, F.length(_bare(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)),
        "",
    )
    return _let(bare, lambda bare: F.when(F.length(bare) == F.length(shape), bare).otherwise(put(bare)))


def _let(value: Column, body) -> Column:
    """body of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after the digits; a column or lambda variable, as it is used repeatedly."""
    n = F.length(digits)
    value = lambda c, i: F.when((n - i) % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return (10 - F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10) % 10


def _part(text: Column, start: Column | int, length: Column | int) -> Column:
    return F.substring(text, F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length)


def kind_of(entity: Column) -> Column:
    out = F.when(entity.rlike(r"^\p{L}+(?: \p{L}+)*$"), "name").when(entity.rlike("^[0-9]{9}$"), "ssn").otherwise("secret")
    for kind, pattern in reversed(PATTERNS[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _renamed(key: str, names: Mapping[str, Sequence[str]]) -> Column:
    """Each name, in lower case, with the next one of its list, in an order that the key decides."""
    pairs, seen = [], set()
    for some in names.values():
        some = [n for n in dict.fromkeys(some) if n.lower() not in seen]  # a name of two lists counts in the first
        seen |= {n.lower() for n in some}
        order = sorted(some, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).hexdigest())
        pairs += [F.lit(x) for name, other in zip(order, [*order[1:], order[0]], strict=True) for x in (name.lower(), other)]
    return F.create_map(*pairs)


#: How often a name is permuted at most until it is no listed one; each time, one in many thousands is.
WALKS = 8


def name_part(part: Column, key: str, names: Mapping[str, Sequence[str]] = NAMES) -> Column:
    """The surrogate of one word of a name: listed names go to listed ones, others to others."""
    renamed = _renamed(key, names)
    other = F.element_at(renamed, F.lower(part))
    other = F.when(part == F.upper(part), F.upper(other)).otherwise(other)
    once = lambda w: _permuted(w, F.lit(key), F.lit("name"), NAME_ALPHABETS, _shift_name)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(part), lambda w, _: F.when(F.map_contains_key(renamed, F.lower(w)), once(w)).otherwise(w))
    return F.coalesce(other, walked)


def surrogate(entity: Column, key: str, names: Mapping[str, Sequence[str]] = NAMES) -> Column:
    """The surrogate of a found entity."""
    return _let(F.struct(entity.alias("e"), kind_of(entity).alias("kind"), _bare(entity).alias("bare")), lambda x: _surrogate(x["e"], x["kind"], x["bare"], key, names))


def _surrogate(entity: Column, kind: Column, bare: Column, key: str, names: Mapping[str, Sequence[str]]) -> Column:
    k, n = F.lit(key), F.length(bare)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = _part(domain, 1, F.length(domain) - F.length(top) - 1)
    email = F.concat(_dressed(_permuted(_bare(local), k, F.lit("local")), local), F.lit("@"), _dressed(_permuted(_bare(host), k, F.lit("host")), host), F.lit("."), top)

    def octets(now: Column, r: Column) -> Column:
        rest = F.array_join(F.filter(now, lambda c, i: (i + r) % 2 == 1), ".")
        return F.transform(now, lambda c, i: F.when((i + r) % 2 == 0, ((c.cast("int") + F.conv(_part(_hash(k, F.lit("ipv4"), r.cast("string"), i.cast("string"), rest), 1, 7), 16, 10).cast("int")) % 256).cast("string")).otherwise(c))

    ipv4 = F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.split(entity, r"\."), octets), ".")
    # The country code and the first digit after it stay.
    stay = F.length(_bare(F.regexp_extract(entity, r"^(?:\+[0-9]{1,3}[^0-9]+|\+[0-9]{1,2}|)[^0-9]*[0-9]", 0)))
    phone = _dressed(F.concat(_part(bare, 1, stay), _permuted(_part(bare, stay + 1, n), k, F.concat(F.lit("phone"), _part(bare, 1, stay)))), entity)
    inner = F.concat(_part(bare, 1, 1), _permuted(_part(bare, 2, n - 2), k, F.concat(F.lit("card"), _part(bare, 1, 1))))
    off = _part(bare, n, 1).cast("int") + 10 - _let(_part(bare, 1, n - 1), _luhn)
    card = _let(inner, lambda x: _dressed(F.concat(x, ((_luhn(x) + off) % 10).cast("string")), entity))
    small = F.lower(entity)
    hexed = _dressed(_permuted(_bare(small), k, kind, HEX), small)
    hexed = F.when(entity.rlike("[A-F]"), F.upper(hexed)).otherwise(hexed)
    name = F.array_join(F.transform(F.split(entity, " "), lambda part: name_part(part, key, names)), " ")
    prefix = F.when(kind == "key", F.length(_bare(F.regexp_extract(entity, f"^(?:{_PREFIX})", 0)))).when(kind == "iban", 2).otherwise(0)
    other = _dressed(F.concat(_part(bare, 1, prefix), _permuted(_part(bare, prefix + 1, n), k, kind)), entity)
    return F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind.isin("ipv6", "hex"), hexed).when(kind == "phone", phone).when(kind == "card", card).when(kind == "name", name).otherwise(other)


def _by_content(text: Column, names: Mapping[str, Sequence[str]], body) -> Column:
    """body of a pattern, the short one for texts that hold names at most."""
    pattern = name_pattern(names)
    return F.when(_hinted(text), body(f"{_DATA}|{pattern}")).otherwise(body(pattern))


def found(text: Column, names: Mapping[str, Sequence[str]] = NAMES) -> Column:
    """The entities of a text, in order."""
    return _by_content(text, names, lambda p: F.regexp_extract_all(text, F.lit(p), 0))


def _words_of_names(text: Column, entities: Column) -> Column:
    """A pattern of the capitalised words of a text's names that never occur in lower case in it; null if there are none."""
    words = F.flatten(F.transform(F.filter(entities, lambda e: e.rlike(r"^\p{Lu}\p{L}+(?: \p{L}+)*$")), lambda e: F.split(e, " ")))
    whole = lambda w: F.concat(F.lit(r"(?<!\p{L})"), w, F.lit(r"(?!\p{L})"))
    words = F.filter(F.array_distinct(words), lambda w: w.rlike(r"^\p{Lu}\p{L}{2,}$") & ~F.regexp_like(text, whole(F.lower(w))))
    return _let(words, lambda w: F.when(F.size(w) > 0, F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(w, "|"), F.lit(r")(?!\p{L})"))))


def replaced(docs: DataFrame, key: str, out_col: str, text_col: str = "text", names: Mapping[str, Sequence[str]] = NAMES) -> DataFrame:
    """docs with every entity of the text replaced; out_col gets the entities and their surrogates, in pairs."""
    held, text = fresh(docs, "entities"), F.col(text_col)
    pattern = fresh(docs, "pattern")
    # The stretches between entities, one more than entities, are joined with the surrogates in turn.
    between = _by_content(text, names, lambda p: F.split(text, p, -1))
    part = lambda w: F.struct(w.alias("entity"), name_part(w, key, names).alias("surrogate"))
    again = lambda s: F.when(F.regexp_like(s, F.col(pattern)), F.transform(F.regexp_extract_all(s, F.col(pattern), 0), part))
    joined = lambda pieces, pairs: F.array_join(F.zip_with(pieces, pairs, lambda a, b: F.concat(a, F.coalesce(b["surrogate"], F.lit("")))), "")
    pieces = F.transform(between, lambda s: F.struct(s.alias("s"), again(s).alias("pairs")))
    told = F.transform(F.col(held), lambda e: F.struct(e.alias("entity"), surrogate(e, key, names).alias("surrogate")))

    def body(x: Column) -> Column:
        plain = F.transform(x["pieces"], lambda p: F.when(p["pairs"].isNull(), p["s"]).otherwise(joined(F.split(p["s"], F.col(pattern), -1), p["pairs"])))
        more = F.flatten(F.transform(F.filter(x["pieces"], lambda p: p["pairs"].isNotNull()), lambda p: p["pairs"]))
        return F.struct(joined(plain, x["told"]).alias("text"), F.concat(x["told"], more).alias("pairs"))

    none = F.array().cast("array<struct<entity:string,surrogate:string>>")
    made = F.when(F.size(held) > 0, _let(F.struct(pieces.alias("pieces"), told.alias("told")), body)).otherwise(F.struct(text.alias("text"), none.alias("pairs")))
    out = docs.withColumn(held, found(text, names))
    out = out.withColumn(pattern, F.when(F.size(held) > 0, _words_of_names(text, F.col(held)))).withColumn(held, made)
    return out.withColumn(text_col, F.col(held)["text"]).withColumn(out_col, F.col(held)["pairs"]).drop(held, pattern)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, names: Mapping[str, Sequence[str]] = NAMES) -> DataFrame:
    """docs with every entity of the text replaced; count_col gets their number."""
    pairs = fresh(docs, "pairs")
    return _counted(replaced(docs, key, pairs, text_col, names), pairs, count_col)


def _counted(out: DataFrame, pairs: str, count_col: str | None) -> DataFrame:
    return (out.withColumn(count_col, F.size(pairs).cast("long")) if count_col else out).drop(pairs)


def collisions(pairs: DataFrame) -> DataFrame:
    """Of rows entity and surrogate, the types and surrogates that stand for more than one entity: none, unless something is wrong."""
    each = pairs.select("entity", kind_of(F.col("entity")).alias("kind"), "surrogate")
    plain = lambda c: F.when(F.col("kind").isin("email", "ipv6", "hex", "name"), F.lower(c)).when(F.col("kind") == "ipv4", c).otherwise(_bare(c))
    each = each.select("kind", plain(F.col("surrogate")).alias("surrogate"), plain(F.col("entity")).alias("entity"))
    # Entities meet by their least and largest, so the shuffle moves a row for each surrogate and task.
    return each.groupBy("kind", "surrogate").agg(F.min("entity").alias("one"), F.max("entity").alias("other")).where("one <> other")


def checked(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, names: Mapping[str, Sequence[str]] = NAMES, attempts: int = 4) -> DataFrame:
    """pseudonymised(), written once and checked by collisions(); again under the next key that follows from key if two entities share a surrogate."""
    pairs = fresh(docs, "pairs")
    for n in range(attempts):
        out = stored(replaced(docs, key if n == 0 else f"{key}#{n}", pairs, text_col, names), "surrogates")
        if not collisions(out.select(F.inline(pairs))).head(1):
            break
    return _counted(out, pairs, count_col)
