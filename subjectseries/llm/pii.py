"""Operator 10: personal data replaced by keyed surrogates, with DataFrame functions only.

Entities are found by one pattern: mail addresses, phone, card, account and social-security
numbers, network addresses, secrets, and person names after a form of address or with a known
first name. A surrogate follows from a secret key, the type and the entity's canonical form, so
an entity has one surrogate in the whole corpus, however it is written (coreference). It keeps
the type's format: digits stay digits, letters keep case and script, card numbers keep a valid
check digit, addresses valid numbers, first names their gender.

Distinctness is checked over the corpus: where two entities share a surrogate, or a surrogate is
itself an entity of the corpus, all but one of them are drawn again until none is left. After
``WIDEN`` draws a surrogate gets longer with each draw, also beyond what its type allows, so a
form of few values never runs out.

Only distinct texts with entities are taken apart; entities are made distinct before they are
drawn, so a third of all rows may hold one entity or be one text.

Edge cases: a null text stays null, an empty one empty, with 0 entities; numbers whose check
digit fails are no cards; a blank to fill in, that is a line of one sign, is no secret; repeated rows are treated alike and all returned; all columns of the
input are kept, and names that clash with helper columns do no harm; an empty table gives no
rows. Very long texts are handled whole.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectseries.llm.common import col, fresh
from subjectseries.session import materialize

KEY = "change-this-key"
#: Draws before a surrogate may also change its length.
WIDEN = 20

MAIL, SECRET, CARD, PHONE, SSN, IBAN, IP4, IP6, PERSON = (
    "mail",
    "secret",
    "card",
    "phone",
    "ssn",
    "iban",
    "ip4",
    "ip6",
    "person",
)
#: First names by gender and script; surrogates come from the same lists.
NAMES = {
    ("f", "latin"): "Anna Maria Emma Laura Julia Sarah Claire Sophie Elena Lucia Carmen Marta Ingrid Helga Alice Nora".split(),
    ("m", "latin"): "John James Peter Thomas Michael David Pierre Louis Hans Klaus Carlos Miguel Pablo Oscar Henry Walter".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана".split(),
    ("m", "cyrillic"): "Иван Петр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Mme Madame Frau Señora Sra Doña Signora Г-жа".split(),
    "m": "Mr Mister Monsieur Herr Señor Sr Don Signor Г-н".split(),
}

_GIVEN = "|".join(n for names in NAMES.values() for n in names)
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
#: Runs are taken whole or bounded, so that no long run is tried again from each of its places.
PATTERNS = {
    SECRET: r"(?i:\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
    r"(?!(?:\+++|/++|_++|\.++|~++|-++)(?![A-Za-z0-9+/_.~-]))[A-Za-z0-9+/_.~-]{8,}+"
    r"|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}+|\bsk-[A-Za-z0-9_-]{20,}+",
    MAIL: r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+",
    IBAN: r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    CARD: r"(?<![0-9.-])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9.-])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|(?<![0-9.])[0-9]{13,19}(?![0-9])",
    SSN: r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    PHONE: r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])"
    r"|(?<![0-9.-])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    IP4: r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    IP6: r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])",
    PERSON: rf"(?<!\p{{L}})(?:(?:{_TITLE})\b\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?|(?:{_GIVEN}) \p{{Lu}}\p{{L}}++)",
}
#: One pattern for all. A look at the next character spares most places the single patterns.
_STARTS = {
    r"(?=[aAtTsSpPgG])": (SECRET,),
    r"(?=[A-Za-z0-9])\b": (MAIL, IP6),
    r"(?=\p{Lu})": (IBAN, PERSON),
    r"(?=[0-9+(])": (CARD, SSN, PHONE, IP4),
}
PATTERN = "|".join(
    f"{look}(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in kinds)})" for look, kinds in _STARTS.items()
)
#: Letters by script and case, vowels apart so that names can be spoken.
_CLASSES = (
    "0123456789",
    "aeiou",
    "AEIOU",
    "bcdfghjklmnpqrstvwxyz",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "аеиоуыэюяё",
    "АЕИОУЫЭЮЯЁ",
    "бвгджзйклмнпрстфхцчшщ",
    "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "àáâãäåæèéêëìíîïòóôõöøùúûü",
    "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ",
)
#: Every class repeated to one width, so that a letter's place tells its class.
_WIDTH = 60
_ALPHABET = "".join((c * _WIDTH)[:_WIDTH] for c in _CLASSES)
_HEX = ("0123456789abcdef" * _WIDTH)[:_WIDTH]
#: What a secret without letters and digits is drawn from; the second has the signs of ``sk-`` keys.
_SIGNS, _SK_SIGNS = (("+/_.~-" * _WIDTH)[:_WIDTH], ("_-" * _WIDTH)[:_WIDTH])
#: Blocks of the other letters with case: Latin, Greek, Cyrillic, Armenian, Georgian, Cherokee,
#: Glagolitic, Coptic, Deseret.
_BLOCKS = (
    (0xC0, 0x180), (0x180, 0x250), (0x250, 0x2B0), (0x1E00, 0x1F00), (0x370, 0x3E2), (0x1F00, 0x2000),
    (0x400, 0x460), (0x460, 0x530), (0x531, 0x590), (0x10A0, 0x10FB), (0x1C90, 0x1CC0), (0x13A0, 0x13FE),
    (0x2C00, 0x2C60), (0x2C80, 0x2CF0), (0x10400, 0x10450),
)
_MORE = tuple(
    letters
    for start, end in _BLOCKS
    for case in ("Ll", "Lu")
    if len(letters := "".join(c for c in map(chr, range(start, end)) if unicodedata.category(c) == case)) > 1
)


def _type(entity: Column) -> Column:
    """The type of a match: the first pattern that it fits alone."""
    tests = {
        SECRET: rf"^(?:{PATTERNS[SECRET]})$",
        MAIL: "@",
        IBAN: "^[A-Z]{2}[0-9]{2}",
        IP6: "^[0-9A-Fa-f]{1,4}:",
        PERSON: r"^\p{Lu}[\p{L}-]",
        SSN: "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
        IP4: rf"^{PATTERNS[IP4]}$",
        CARD: rf"^(?:{PATTERNS[CARD]})$",
    }
    out = F.lit(PHONE)
    for name, test in reversed(tests.items()):
        out = F.when(entity.rlike(test), F.lit(name)).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Weighted digit sum modulo 10, the last digit being the check digit."""
    places = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    weighed = F.transform(
        places,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")
        ),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10


def _numeric(kind: Column) -> Column:
    return kind.isin(CARD, PHONE, SSN)


def _lead(value: Column) -> Column:
    """The part of a match that is kept: a secret's label, a name's form of address."""
    label = F.regexp_extract(value, r"^(?i)((?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?|AKIA|gh[pousr]_|sk-)", 1)
    title = F.regexp_extract(value, rf"^((?:{_TITLE})\b\.? )", 1)
    return F.when(label != "", label).otherwise(title)


def _stream(seed: Column) -> Column:
    """256 hexadecimal digits that follow from the seed."""
    return F.concat(*(F.sha2(F.concat_ws("|", seed, F.lit(str(k))), 256) for k in range(4)))


def _number(stream: Column, at: Column, below: Column | int) -> Column:
    """A number drawn from four digits of the stream at a place, which wraps around."""
    start = (at * 4) % 252 + 1
    return F.conv(stream.substr(start.cast("int"), F.lit(4)), 16, 10).cast("int") % below


def _other_letter(c: Column, number: Column) -> Column:
    """A letter outside the alphabet drawn within its block and case, one without case within
    the 64 code points around it; other characters stay."""
    point = F.ascii(c)
    near = F.decode(F.unhex(F.lpad(F.hex(point - point % 64 + number % 64), 8, "0")), "UTF-32")
    caseless = r"^[\p{L}&&[^\p{Lu}\p{Ll}]]$"
    out = F.when(c.rlike(caseless) & near.rlike(caseless), near).otherwise(c)
    for letters in reversed(_MORE):
        drawn = F.lit(letters).substr(number % len(letters) + 1, F.lit(1))
        out = F.when(F.instr(F.lit(letters), c) > 0, drawn).otherwise(out)
    return F.when(c.rlike(r"\p{L}"), out).otherwise(c)


def _redraw(value: Column, stream: Column, alphabet: Column) -> Column:
    """Every character drawn anew within its class of the alphabet, other letters within their
    block; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        place = F.instr(alphabet, c)
        start = F.floor((place - 1) / _WIDTH).cast("int") * _WIDTH
        drawn = alphabet.substr(start + _number(stream, i, _WIDTH) + 1, F.lit(1))
        return F.when(place > 0, drawn).otherwise(_other_letter(c, _number(stream, i, 1 << 16)))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, one), "")


def _gender(title: Column, given: Column) -> Column:
    women = [n.lower() for (g, _), names in NAMES.items() if g == "f" for n in names]
    return (
        F.when(F.regexp_replace(title, r"[. ]", "").isin(TITLES["f"]), "f")
        .when(title != "", "m")
        .when(F.lower(given).isin(women), "f")
        .otherwise("m")
    )


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon, gender, attempt) with the canonical surrogate of each.

    Each step is a column of its own, as later ones use it more than once. Of a name, the family
    name depends on the last word alone, so relatives stay relatives; the first name comes from
    the list of its gender and script. Draws from ``WIDEN`` on lengthen what is drawn from: mail
    addresses at their start, others at their end.
    """
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    longer = F.greatest(attempt - (WIDEN - 1), F.lit(0))

    def seed(*parts: Column) -> Column:
        return _stream(F.concat_ws("|", F.lit(key), *parts, attempt.cast("string")))

    person = kind == PERSON
    words = F.split(canon, " ")
    family = F.lower(F.element_at(words, -1))
    lower_hex = (kind == IP6) | ((kind == SECRET) & canon.rlike("^[0-9a-f]+$"))
    upper_hex = (kind == SECRET) & canon.rlike("^[0-9A-F]+$")
    steps = (
        entities.withColumn("stream", F.when(person, seed(F.lit("family"), family)).otherwise(seed(kind, canon)))
        .withColumn("given_stream", F.when(person, seed(F.lit("given"), F.lower(F.element_at(words, 1)))))
        .withColumn(
            "alphabet",
            F.when(lower_hex, _HEX)
            .when(upper_hex, _HEX.upper())
            .when((kind == SECRET) & canon.rlike("^[_-]+$"), _SK_SIGNS)
            .when((kind == SECRET) & ~canon.rlike("[A-Za-z0-9]"), _SIGNS)
            .otherwise(_ALPHABET),
        )
        .withColumn("source", F.when(person, F.element_at(words, -1)).otherwise(canon))
        .withColumn(
            "source",
            F.when(longer == 0, F.col("source"))
            .when(kind == MAIL, F.concat(F.repeat(F.substring("source", 1, 1), longer), "source"))
            # Addresses of full groups get further groups, as groups have a largest size.
            .when(kind == IP6, F.concat(F.regexp_replace("source", "[0-9a-f]+", "0000"), F.repeat(F.lit(":0000"), longer - 1)))
            .otherwise(F.concat("source", F.repeat(F.substring("source", -1, 1), longer))),
        )
    )
    steps = steps.withColumn("free", _redraw(F.col("source"), F.col("stream"), F.col("alphabet")))
    free, stream, size = F.col("free"), F.col("stream"), F.length("source")
    # A card keeps its first digit, which names the kind of card, and gets a valid check digit.
    steps = steps.withColumn(
        "trunk", F.when(kind == CARD, F.concat(F.substring(canon, 1, 1), free.substr(F.lit(2), size - 2)))
    )
    card = F.concat("trunk", ((10 - _luhn(F.concat("trunk", F.lit("0")))) % 10).cast("string"))
    octets = F.split(canon, r"\.")
    octet = F.transform(
        F.concat(octets, F.array_repeat(F.lit("100"), F.greatest(longer - WIDEN, F.lit(0)))),
        lambda c, i: F.when((F.length(c) == 1) & (attempt < WIDEN), 1 + _number(stream, i, 9))
        .when((F.length(c) == 2) & (attempt < WIDEN), 10 + _number(stream, i, 90))
        .otherwise(100 + _number(stream, i, 156))
        .cast("string"),
    )
    script = F.when(canon.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    first = F.lit(None).cast("string")
    for (gender, writing), names in NAMES.items():
        name = F.get(F.array(*map(F.lit, names)), _number(F.col("given_stream"), F.lit(0), len(names)))
        first = F.when((F.col("gender") == gender) & (script == writing), name).otherwise(first)
    # The last label of a mail address stays, so the address keeps its form.
    ending = F.substring_index(canon, ".", -1)
    return steps.withColumn(
        "surrogate",
        F.when(kind == CARD, card)
        .when(kind == PHONE, F.concat(F.substring(canon, 1, 1), free.substr(F.lit(2), size)))
        .when(kind == SSN, F.concat(F.lit("9"), free.substr(F.lit(2), size)))
        .when(kind == IP4, F.array_join(octet, "."))
        .when(kind == MAIL, F.concat(free.substr(F.lit(1), size - F.length(ending)), ending))
        .when(kind == IBAN, F.concat(F.substring(canon, 1, 2), free.substr(F.lit(3), size)))
        .when(person & (F.size(words) > 1), F.concat_ws(" ", first, free))
        .otherwise(free),
    ).select(*entities.columns, "surrogate")


def _rendered(kind: Column, value: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the form that the entity has in the text."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))
    spaced = F.aggregate(
        chars,
        start,
        lambda a, c: F.when(
            F.when(_numeric(kind), c.rlike("[0-9]")).otherwise(c != " "),
            F.struct((a["k"] + 1).alias("k"), F.concat(a["out"], surrogate.substr(a["k"], F.lit(1))).alias("out")),
        ).otherwise(F.struct(a["k"].alias("k"), F.concat(a["out"], c).alias("out"))),
    )
    spaced = F.concat(spaced["out"], surrogate.substr(spaced["k"], F.length(surrogate)))
    # What a lengthened surrogate has more stands before the places of the entity's characters.
    more = F.greatest(F.length(surrogate) - F.length(value), F.lit(0))
    cased = F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(surrogate.substr(i + more + 1, F.lit(1)))).otherwise(
                surrogate.substr(i + more + 1, F.lit(1))
            ),
        ),
        "",
    )
    cased = F.concat(surrogate.substr(F.lit(1), more), cased)
    return (
        F.when(_numeric(kind) | (kind == IBAN), spaced)
        .when(kind.isin(MAIL, IP6), cased)
        .otherwise(surrogate)
    )


def entities(docs: DataFrame, text: str) -> DataFrame:
    """(key, pos, match, kind, lead, value, canon, gender): every entity of every distinct text."""
    key = F.sha2(col(text).cast("string"), 256)
    texts = (
        docs.where(col(text).cast("string").rlike(PATTERN))
        .select(key.alias("key"), F.regexp_extract_all(col(text).cast("string"), F.lit(PATTERN), F.lit(0)).alias("matches"))
        .dropDuplicates(["key"])
    )
    found = texts.select("key", F.posexplode("matches").alias("pos", "match")).withColumn("kind", _type(F.col("match")))
    found = found.withColumn("lead", F.when(F.col("kind").isin(SECRET, PERSON), _lead(F.col("match"))).otherwise(F.lit("")))
    value = F.col("match").substr(F.length("lead") + 1, F.length("match"))
    found = found.withColumn("value", value)
    kind = F.col("kind")
    canon = (
        F.when(_numeric(kind), _digits(F.col("value")))
        .when(kind == IBAN, F.replace("value", F.lit(" "), F.lit("")))
        .when(kind.isin(MAIL, IP6), F.lower("value"))
        .otherwise(F.col("value"))
    )
    given = F.substring_index("value", " ", 1)
    return (
        found.withColumn("canon", canon)
        .withColumn("gender", F.when(kind == PERSON, _gender(F.col("lead"), given)).otherwise(F.lit("")))
        .where((kind != CARD) | (_luhn(F.col("canon")) == 0))
    )


def mapping(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, gender, surrogate): distinct surrogates that are no entities themselves."""
    names = ["kind", "canon", "gender"]
    base = materialize(found.select(*names).distinct().withColumn("attempt", F.lit(0)), "pii-entities")
    held = materialize(drawn(base, key), "pii-surrogates")
    originals = base.select("kind", F.col("canon").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    while True:
        first = held.groupBy("kind", "surrogate").agg(
            F.count("*").alias("n"), F.min(F.struct("attempt", "canon", "gender")).alias("keeps")
        )
        checked = held.join(first, ["kind", "surrogate"]).join(originals, ["kind", "surrogate"], "left")
        clash = F.col("taken").isNotNull() | (
            (F.col("n") > 1) & (F.struct("attempt", "canon", "gender") != F.col("keeps"))
        )
        checked = materialize(checked.withColumn("clash", clash), "pii-checked")
        if checked.where("clash").isEmpty():
            return held.select(*names, "surrogate")
        again = checked.where("clash").select(*names, (F.col("attempt") + 1).alias("attempt"))
        kept = checked.where("not clash").select(*names, "attempt", "surrogate")
        held = materialize(
            kept.unionByName(drawn(again, key).select(*names, "attempt", "surrogate")),
            "pii-surrogates",
        )


def replace_entities(docs: DataFrame, text: str = "text", key: str = KEY, counted: bool = False) -> DataFrame:
    """``docs`` with surrogates in place of entities; with ``counted``, a column n_entities too."""
    found = materialize(entities(docs, text), "pii-found")
    chosen = mapping(found, key)
    swapped = (
        found.join(chosen, ["kind", "canon", "gender"])
        .withColumn("put", F.concat("lead", _rendered(F.col("kind"), F.col("value"), F.col("surrogate"))))
        .groupBy("key")
        .agg(F.collect_list(F.struct("pos", "put")).alias("puts"))
    )
    swapped = materialize(swapped, "pii-swapped")
    mark, puts, count = fresh(docs, "pii_key"), fresh(docs, "pii_puts"), "n_entities"
    swapped = swapped.select(F.col("key").alias(mark), F.col("puts").alias(puts))
    value = col(text).cast("string")
    touched = F.coalesce(value.rlike(PATTERN), F.lit(False))
    keyed = docs.where(touched).withColumn(mark, F.sha2(value, 256)).join(swapped, mark, "left")
    gaps = F.split(value, PATTERN, -1)
    matches = F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0))
    by_place = F.map_from_entries(F.coalesce(col(puts), F.array().cast("array<struct<pos:int,put:string>>")))
    # The gaps and, after each but the last, the match or what takes its place.
    pieces = F.transform(
        gaps,
        lambda gap, i: F.concat(gap, F.coalesce(F.try_element_at(by_place, i), F.get(matches, i), F.lit(""))),
    )
    columns = docs.columns
    extra = [F.when(col(puts).isNull(), 0).otherwise(F.size(col(puts))).cast("int").alias(count)] if counted else []
    done = keyed.select(*[F.array_join(pieces, "").alias(c) if c == text else col(c) for c in columns], *extra)
    clean = docs.where(~touched)
    if counted:
        clean = clean.select(*map(col, columns), F.lit(0).alias(count))
    return clean.union(done.select(*map(col, clean.columns)))
