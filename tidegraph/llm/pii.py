"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern, once, and replaced where they stand by surrogates that are a function of a key and the
entity alone: the same entity has the same surrogate in every document (coreference), with no table to join. The match
itself says the kind; what tells a secret from the rest, its label, is part of the match and stays.

Distinct entities keep distinct surrogates because every step is one-to-one. A string is read as positions within classes of
characters (digits; hexadecimal and other letters, or vowels and consonants in names; by script), and goes through a keyed
Feistel network that moves each position within its class: length, case, layout, script and alphabet stay. The network
P is used as P, a keyed rotation of one position, and P backwards, which leaves no string as it was. So:

- Digits of phones, cards and social security numbers are permuted; a phone's country code stays, a card passes the
  Luhn check and an IBAN its check digits exactly if the original does; the octets of an IP address stay octets.
- Names after a title: given names of the fixed lists go round within their list (gender and script), others keep their last letter,
  which shows the gender; no invented given name is one of the lists. Surnames are permuted by vowels and consonants.
- E-mail addresses keep the shape of both sides and get the reserved ending .example.
- Secrets keep the shape; one with a letter of another script, or with nothing to permute, becomes 64 hexadecimal digits.

Distinct entities are compared with distinct surrogates over all documents, before anything is replaced; should two share
one, or one be its own, the next key is taken.

Null text stays null and has no entities; texts of any length are taken whole. Rows that are alike get like results; an
empty table gives an empty result. Only the text column is read and replaced; all others keep their names and values.
Not found: names without a title or in other scripts than Latin, Greek and Cyrillic, postal addresses, dates of birth, e-mail
addresses at domains with other letters than ASCII, unquoted secrets without a digit, phones without separators or a leading +.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import written

# Titles; common given names; classes of letters by script; country codes of one and two digits.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Г-н Г-жа Господин Госпожа Κύριος Κυρία".split()
GIVEN = [
    "James Robert Michael David Thomas Daniel Paul Mark Peter Simon Lucas Martin Oscar Felix Hugo Jonas".split(),
    "Mary Anna Laura Julia Sarah Emma Clara Sofia Alice Helen Nora Lucy Marta Elena Ida Rosa".split(),
    "Иван Пётр Павел Олег Игорь Антон Денис Юрий".split(),
    "Анна Мария Ольга Елена Ирина Вера Нина Дарья".split(),
]
DIGITS = "0123456789"
SCRIPTS = ["àáâãäåèéêëìíîïòóôõöùúûü", "çñšžćčłřůý", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "аеиоуыэюяёіїє", "бвгджзйклмнпрстфхцчшщґ", "ъь"]
TOKEN_CLASSES = [DIGITS, "abcdef", "ghijklmnopqrstuvwxyz", *SCRIPTS]
NAME_CLASSES = [DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", *SCRIPTS]
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_UPPER = "".join(c.upper() for c in "".join(NAME_CLASSES[1:]))
_PART = rf"[{_UPPER}](?:['’\-]?\p{{L}})+"
_TITLE = rf"(?:{'|'.join(TITLES)})\.?"
_LABEL = r"(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)[\"']?[ ]{0,2}[=:][ ]{0,2}"
PATTERNS = {
    "secret": rf"{_LABEL}(?:[\"'][^\"'\s]{{6,}}+(?=[\"'])|(?=[^\s\"',;]*\d)[^\s\"',;]{{7,}}[^\s\"',;.!?)])",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "access": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+\d(?:[ .\-]?\(?\d\)?){7,14}|\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\d{3}[ .\-]\d{3}[ .\-]\d{4}|0\d{1,3}[ .\-]\d{3,4}[ .\-]\d{3,4})(?!\w)",
    "card": r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w)",
    "name": rf"(?<!\p{{L}}){_TITLE} {_PART}(?: {_PART}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every pattern asks for one of these, so other texts need no search.
HINT = rf"[0-9@]|AKIA|(?i:token|secret|passw|api[_\-]?key|access[_\-]?key)|(?:{'|'.join(TITLES)})\.? [{_UPPER}]"
#: Rounds of the network and their direction; in the middle a rotation.
STEPS = [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (3, -1), (2, -1), (1, -1), (0, -1)]


def entities(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def kind_of(entity: Column) -> Column:
    """Key of PATTERNS. What a pattern matches no other one does: only secrets have = or :, only they and e-mails an @, and so on."""
    n_digits = F.length(F.regexp_replace(entity, r"\D", ""))
    rules = {
        "secret": entity.rlike(rf"^{_LABEL}"),
        "email": entity.contains("@"),
        "name": entity.rlike(rf"^{_TITLE} "),
        "access": entity.startswith("AKIA"),
        "iban": entity.rlike(r"^[A-Z]{2}\d"),
        "ip": entity.rlike(r"^\d+\.\d+\.\d+\.\d+$"),
        "ssn": entity.rlike(r"^\d{3}-\d{2}-\d{4}$"),
        "card": (n_digits > 12) & ~entity.rlike(r"^[+(]"),
    }
    return F.coalesce(*(F.when(test, F.lit(kind)) for kind, test in rules.items()), F.lit("phone"))


def let(value: Column, body) -> Column:
    """body of a value that is made once."""
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _after(text: Column, n: Column | int) -> Column:
    return F.substring(text, (F.lit(n) if isinstance(n, int) else n) + 1, F.length(text))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


class Surrogates:
    """key: a secret; attempt: which of the keys derived from it."""

    def __init__(self, key: str, attempt: int = 0) -> None:
        self.key, self.attempt = f"{key}/{attempt}", attempt
        # The names of a list go round in an order that the key gives.
        self.given: dict[str, str] = {}
        for names in GIVEN:
            order = sorted(names, key=lambda x: hashlib.sha256(f"{self.key}:given:{x}".encode()).digest())
            self.given |= dict(zip(order, [*order[1:], order[0]], strict=True))

    def permuted(self, tag: Column, places: Column, sizes: Column) -> Column:
        """places (each below its size), moved one-to-one; none stays as it was if a size is over 1."""

        def network(x: Column) -> Column:
            half = F.floor(F.size(x["sizes"]) / 2)
            turned = F.array_position(F.transform(x["sizes"], lambda z: z > 1), True) - 1

            def step(s: Column, k: Column) -> Column:
                on_left = k["round"] % 2 == 0
                other = F.array_join(F.transform(s, lambda v, i: F.when((k["sign"] != 0) & ((i < half) != on_left), v.cast("string")).otherwise("")), ",")

                def moved(d: Column) -> Column:
                    number = lambda i: F.conv(F.substring(F.sha2(F.concat(d, F.lit(":"), i.cast("string")).cast("binary"), 256), 1, 14), 16, 10).cast("long")
                    size = lambda i: F.element_at(x["sizes"], i + 1)
                    by = lambda i: F.when(k["sign"] == 0, 1 + number(i) % (size(i) - 1)).otherwise(k["sign"] * number(i))
                    own = lambda i: F.when(k["sign"] == 0, i == turned).otherwise((i < half) == on_left)
                    return F.transform(s, lambda v, i: F.when(own(i) & (size(i) > 1), F.pmod(v + by(i), size(i)).cast("int")).otherwise(v))

                return let(F.sha2(F.concat_ws("/", F.lit(self.key), x["tag"], k["round"].cast("string"), x["shape"], other).cast("binary"), 256), moved)

            steps = F.array(*(F.struct(F.lit(a).alias("round"), F.lit(b).alias("sign")) for a, b in STEPS))
            return F.aggregate(steps, x["places"], step)

        return let(F.struct(tag.alias("tag"), places.alias("places"), sizes.alias("sizes"), F.array_join(sizes.cast("array<string>"), ",").alias("shape")), network)

    def shaped(self, tag: Column, text: Column, name: Column) -> Column:
        """text with each character moved within its class; name: whether by NAME_CLASSES."""
        alphabets = ["".join(c) for c in (TOKEN_CLASSES, NAME_CLASSES)]
        starts, sizes = ([F.array(*(F.lit(v) for c, at in _placed(classes) for v in [at if what else len(c)] * len(c))) for classes in (TOKEN_CLASSES, NAME_CLASSES)] for what in (True, False))
        pick = lambda pair: F.when(name, pair[1]).otherwise(pair[0])
        alphabet = pick([F.lit(a) for a in alphabets])

        def place(c: Column) -> Column:
            return let(F.position(F.lower(c), alphabet), lambda p: F.struct(c.alias("c"), p.alias("p"), F.when(p > 0, F.get(pick(starts), p - 1)).otherwise(0).alias("start"), F.when(p > 0, F.get(pick(sizes), p - 1)).otherwise(1).alias("size")))

        def render(chars: Column) -> Column:
            places = F.transform(chars, lambda x: F.when(x["p"] > 0, x["p"] - 1 - x["start"]).otherwise(0))
            moved = self.permuted(tag, places, F.transform(chars, lambda x: x["size"]))

            def put(x: Column, v: Column) -> Column:
                new = F.substring(alphabet, x["start"] + v + 1, F.lit(1))
                return F.when(x["p"] == 0, x["c"]).when(x["c"] != F.lower(x["c"]), F.upper(new)).otherwise(new)

            return F.array_join(F.zip_with(chars, moved, put), "")

        return let(F.transform(_chars(text), place), render)

    def _part(self, part: Column) -> Column:
        """The surrogate of a struct(tag, text, name, given)."""
        listed = F.create_map(*(F.lit(x) for pair in self.given.items() for x in pair))
        keep = part["given"].cast("int")
        digest = F.sha2(F.concat_ws("/", F.lit(self.key), part["tag"], part["text"]).cast("binary"), 256)
        known = "".join(TOKEN_CLASSES)
        strange = ~part["name"] & (~F.lower(part["text"]).rlike(f"[{known}]") | F.lower(part["text"]).rlike(rf"[^\P{{L}}{known}]"))

        def step(s: Column, i: Column) -> Column:
            n = F.length(s) - keep
            # An invented name that is in a list is taken on, so that it isn't a listed one's surrogate.
            again = (i == 0) | (part["given"] & F.map_contains_key(listed, s))
            return F.when(again, F.concat(self.shaped(part["tag"], F.substring(s, F.lit(1), n), part["name"]), F.substring(s, n + 1, keep))).otherwise(s)

        walked = F.aggregate(F.array(*map(F.lit, range(4))), part["text"], step)
        return F.when(part["given"] & F.map_contains_key(listed, part["text"]), F.try_element_at(listed, part["text"])).when(strange, digest).otherwise(walked)

    def ip(self, entity: Column) -> Column:
        octets = F.split(entity, r"\.").cast("array<int>")
        return F.array_join(self.permuted(F.lit("ip"), octets, F.array(*[F.lit(256)] * 4)).cast("array<string>"), ".")

    def of(self, entity: Column) -> Column:
        return let(F.struct(entity.alias("e"), kind_of(entity).alias("kind")), self._of)

    def _of(self, x: Column) -> Column:
        entity, kind = x["e"], x["kind"]
        at = F.instr(entity, "@")
        low = F.lower(entity)
        host, ending = F.regexp_extract(_after(low, at), r"^(.*)\.", 1), F.regexp_extract(low, r"\.([^.]+)$", 1)
        label = F.regexp_extract(entity, rf"^{_LABEL}[\"']?", 0)
        value = F.when(kind == "secret", _after(entity, F.length(label))).otherwise(entity)
        access = value.rlike("^AKIA[0-9A-Z]{16}$")
        code = F.when(entity.startswith("+"), F.regexp_extract(_digits(entity), f"^(?:{COUNTRY})", 0)).otherwise("")
        bban = F.regexp_replace(_after(entity, 4), " ", "")
        body = F.substring(_digits(entity), F.lit(1), F.length(_digits(entity)) - 1)
        title = F.regexp_extract(entity, rf"^{_TITLE} ", 0)
        words = F.split(_after(entity, F.length(title)), " ")
        part = lambda tag, text, name=False, given=F.lit(False): F.struct(F.lit(tag).alias("tag"), text.alias("text"), F.lit(name).alias("name"), given.alias("given"))
        parts = (
            F.when(kind == "name", F.transform(words, lambda w, i: F.struct(F.when(i < F.size(words) - 1, "given").otherwise("surname").alias("tag"), w.alias("text"), F.lit(True).alias("name"), (i < F.size(words) - 1).alias("given"))))
            .when(kind == "email", F.array(part("email", F.substring(low, F.lit(1), at - 1)), part("domain", host, True)))
            .when(access, F.array(part("access", _after(value, 4))))
            .when(kind == "secret", F.array(part("secret", value)))
            .when(kind == "iban", F.array(part("iban", bban)))
            .when(kind == "card", F.array(part("card", body)))
            .when(kind == "phone", F.array(part("phone", _after(_digits(entity), F.length(code)))))
            .otherwise(F.array(part("ssn", _digits(entity))))
        )

        def render(out: Column) -> Column:
            last = F.substring(_digits(entity), F.length(_digits(entity)), F.lit(1)).cast("int")
            checked = F.pmod(F.substring(entity, 3, 2).cast("int") - _iban_check(entity, bban) + _iban_check(entity, out[0]), F.lit(100))
            return (
                F.when(kind == "name", F.concat(title, F.array_join(out, " ")))
                .when(kind == "email", F.concat(out[0], F.lit("@"), out[1], F.lit("."), ending, F.lit(".example")))
                .when(access, F.concat(label, F.lit("AKIA"), out[0]))
                .when(kind == "secret", F.concat(label, out[0]))
                .when(kind == "iban", F.concat(F.substring(entity, 1, 2), F.lpad(checked.cast("string"), 2, "0"), _laid_out(_after(entity, 4), out[0], "[A-Z0-9]")))
                .when(kind == "card", _laid_out(entity, F.concat(out[0], F.pmod(_luhn(out[0]) + last - _luhn(body), F.lit(10)).cast("string"))))
                .otherwise(_laid_out(entity, F.concat(F.when(kind == "phone", code).otherwise(""), out[0])))
            )

        return F.when(kind == "ip", self.ip(entity)).otherwise(let(F.transform(parts, self._part), render))


def _placed(classes: list[str]) -> list[tuple[str, int]]:
    """The classes, and where each begins in the alphabet they make."""
    return [(c, sum(map(len, classes[:i]))) for i, c in enumerate(classes)]


def _luhn(body: Column) -> Column:
    """The check digit of a card number without it."""
    doubled = F.transform(F.reverse(_chars(body)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, b: a + b), F.lit(10))


def _iban_check(entity: Column, bban: Column) -> Column:
    """The check digits of an account number of the entity's country."""
    values = F.transform(_chars(F.concat(bban, F.substring(entity, 1, 2), F.lit("00"))), lambda c: F.conv(c, 36, 10).cast("int"))
    return 98 - F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _laid_out(entity: Column, chars: Column, kind: str = r"\d") -> Column:
    """entity with the characters in place of its own of that kind, in order."""
    between = F.split(entity, kind, -1)
    return F.array_join(F.transform(between, lambda s, i: F.concat(s, F.substring(chars, i + 1, F.lit(1)))), "")


def canonical(entity: Column, kind: Column) -> Column:
    """Mentions of one entity have one canonical form."""
    value = F.regexp_replace(entity, rf"^{_LABEL}[\"']?", "")
    plain = (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "ssn"), _digits(entity))
        .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), _digits(entity)))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "name", F.regexp_replace(entity, rf"^{_TITLE} ", ""))
        .when(kind == "secret", value)
        .otherwise(entity)
    )
    return F.concat_ws(":", F.when((kind == "secret") & value.rlike("^AKIA[0-9A-Z]{16}$"), "access").otherwise(kind), plain)


def checked_key(found: DataFrame, key: str, attempts: int = 8) -> Surrogates:
    """Surrogates under the first key that leaves distinct entities (column e, of all texts) distinct, and none as it was."""
    # An entity costs far more than its bytes tell: partitions as many as set, not as few as their size allows.
    distinct = found.select("e").distinct().repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "e")
    for attempt in range(attempts):
        made = Surrogates(key, attempt)
        pairs = distinct.select("e", kind_of(F.col("e")).alias("kind"), made.of(F.col("e")).alias("s"))
        pairs = pairs.select(canonical(F.col("e"), F.col("kind")).alias("e"), canonical(F.col("s"), F.col("kind")).alias("s"))
        clash = pairs.groupBy("s").agg(F.min("e").alias("a"), F.max("e").alias("b"), F.max(F.col("e") == F.col("s")).alias("same")).where("a <> b OR same")
        if clash.isEmpty():
            return made
    raise ValueError(f"surrogates clash under {attempts} keys")


def with_surrogates(docs: DataFrame, key: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """docs with surrogates in place of the entities in the text. counts: a column to add, map of kind to number of mentions."""
    columns = docs.columns
    mark = "__found"
    while mark in columns:
        mark += "_"
    marked = written(docs.withColumn(mark, entities(F.col(text))))  # texts are searched once
    made = checked_key(marked.select(F.explode(mark).alias("e")), key)
    pieces = F.split(F.col(text), ANY, -1)
    surrogates = F.transform(F.col(mark), made.of)
    replaced = let(surrogates, lambda s: F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(s, i), F.lit("")))), ""))
    out = marked
    if counts:
        kinds = F.transform(F.col(mark), kind_of)
        out = out.withColumn(counts, F.map_from_arrays(F.array(*map(F.lit, PATTERNS)), F.array(*(F.size(kinds) - F.size(F.array_remove(kinds, name)) for name in PATTERNS))))
        columns = [*columns, counts]
    return out.withColumn(text, F.when(F.size(mark) > 0, replaced).otherwise(F.col(text))).select(*columns)
