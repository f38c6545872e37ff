"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

Entities are e-mail addresses, phone numbers, payment cards (valid by Luhn), IPv4 addresses, social
security numbers, bank accounts (IBAN), access keys, values of password, token and key assignments, and
names after a form of address. All is done with built-in expressions.

Mentions of one entity corefer. A name is known by its parts: "Mr. John Smith" and "Mr. Smith" share the
surrogate of "smith", and a capitalised "John" or "Smith" elsewhere in the text gets it too; a form of
address without gender follows the text's other mentions of the name. Numbers are brought to one form
with country code, 1 where none is written. Not linked: names of texts that nowhere have them after a form
of address, third and later words of a name, initials, names in small letters, numbers written with
another trunk or exit prefix than "+".

The corpus's distinct mentions are brought to a normal form (digits of a number, lower case of an
address), so that all mentions of one entity have one surrogate, each in its own format. A surrogate
is made from a keyed hash of type and normal form: digits stay digits, letters letters of their case,
card numbers stay valid, area codes possible, addresses in the domain ``example``, IPv4 addresses in a
reserved block, names get the ending of their gender and letters of their script. Surrogates are then
checked over the whole corpus: no two entities of a type share one, and none is a real entity of it;
those that clash are made again from the next hash until none does. As a shape can have fewer texts than
entities, a surrogate grows by a character a round after some rounds. The one that is older, and of
those of one round the one with the smaller normal form, keeps its surrogate.

Null texts stay null and empty ones empty. Equal texts are treated once and stay equal. Documents
without an entity pass unchanged. Rows may repeat; very long texts are read whole; an empty table gives no
row; all columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import stage_table
from broadsheet.llm.neardup import node_key

KEY = "surrogates-1"
#: From this attempt on a surrogate grows by one keyed character a round, as its shape may have no free one.
WIDEN = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LETTER = r"[\p{L}'’-]"
_NAME = rf"\p{{Lu}}{_LETTER}++(?: \p{{Lu}}{_LETTER}++)?"
_PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
#: First digits 3 to 6, and of those with 2 the series in use, so that a date is none.
_FIRST = r"(?:2[2-7]|[3-6]\d)\d{2}"
#: Cards as printed: groups of four, 4-6-5 and 4-6-4.
_PRINTED = rf"{_FIRST}(?:(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}|[ -]?\d{{6}}[ -]?\d{{4,5}})(?!\d)"
#: What a run of digits doesn't go on into.
_OTHER = rf"(?![ -](?:{_PHONE}|{_SSN}|{_IPV4}))"
#: A printed card and what may be its last group, or any run of 13 to 19 digits with single spaces or hyphens.
#: Which of its groups are the card is found by the check digit (``_card``).
_CARD = rf"(?<![\d.-])(?:{_PRINTED}(?:{_OTHER}[ -]\d{{1,3}}(?!\d))?|(?:2[ -]?[2-7]|[3-6])(?:{_OTHER}(?![ -]{_PRINTED})[ -]?\d){{12,18}}(?!\d))"
#: Order matters: of two that match at one place the first is taken. Repetitions are bounded or possessive.
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[/+_.-]*+[A-Za-z0-9])[A-Za-z0-9/+_.-]{8,}+[\"']?)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": _SSN,
    "phone": _PHONE,
    "phone_plus": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "card": _CARD,
    "ipv4": _IPV4,
    "woman": rf"\b(?:Mrs|Ms|Miss|Frau|Señora|Sra|Dra|Madame|Mme|Mlle|госпожа)\.? {_NAME}",
    "man": rf"\b(?:(?:Mr|Herr|Señor|Monsieur|господин)\.?|Sr\.|(?<!\p{{L}}\. ?)M\.) {_NAME}",
    "person": rf"\b(?:Dr|Prof)\.? {_NAME}",
}
ANY = "|".join(PATTERNS.values())
#: A text without such a character, a form of address or an access key's beginning has no entity. This passes most texts
#: by plain searches, which cost far less than the patterns.
QUICK = "[0-9@=:]"
ADDRESS = ("Mr", "Ms", "Miss", "Frau", "Herr", "Señor", "Madame", "Monsieur", "госпо", "M. ", "Mme", "Mlle", "Sr.", "Sra", "Dr", "Prof")
#: The first letters of access keys, which may have no digit.
ACCESS = ("AKIA", "ASIA")
#: Kinds of names; "person" has no gender of its own and follows another mention in its text.
NAMED = ("woman", "man", "person")
#: What follows a name within its word: a possessive, quotes, a hyphen.
_TAIL = r"(?:['’][sS])?['’-]*$"
#: Country codes of the numbering plan.
_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_VALUE = r"""^(.*?[=:]\s*["']?)([^"'\s=:]+)(["']?)$"""
_DIGITS = ("phone", "phone_plus", "ssn", "card", "ipv4")


def may_have_entity(text: Column) -> Column:
    found = text.rlike(QUICK)
    for word in ADDRESS + ACCESS:
        found = found | text.contains(word)
    return found


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, from the right."""
    n = F.length(digits)
    terms = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: (
            F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int"))
            .otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int"))
        ),
    )
    return F.aggregate(terms, F.lit(0), lambda total, x: total + x)


def _card(mention: Column) -> Column:
    """The longest run of whole groups of ``mention`` that is a card number, as it is written; null if none is."""
    n, gap = F.length(mention), lambda i: F.substring(mention, i, F.lit(1)).isin(" ", "-")
    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda i: (i == 1) | gap(i - 1))
    ends = F.filter(places, lambda j: (j == n) | gap(j + 1))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(ends, lambda j: F.substring(mention, i, j - i + 1))))
    shaped = F.filter(runs, lambda r: r.rlike(r"^(?:2[ -]?[2-7]|[3-6])(?:[ -]?\d){12,18}$"))
    valid = F.filter(shaped, lambda r: _luhn(F.regexp_replace(r, r"\D", "")) % 10 == 0)
    return F.array_max(F.transform(valid, lambda r: F.struct(F.length(F.regexp_replace(r, r"\D", "")).alias("n"), r.alias("run"))))["run"]


def classified(mentions: DataFrame) -> DataFrame:
    """``mention, kind, norm`` of every mention that is an entity."""
    m = F.col("mention")
    kind = F.coalesce(*(F.when(m.rlike(f"^(?:{p})$"), F.lit(name)) for name, p in PATTERNS.items()))
    digits = F.regexp_replace(m, r"\D", "")
    bare = F.regexp_replace(F.regexp_replace(m, r"^\S+ ", ""), r"\s+", " ")
    norm = (
        F.when(F.col("kind") == "secret", F.regexp_extract(m, _VALUE, 2))
        .when(F.col("kind") == "email", F.lower(m))
        .when(F.col("kind") == "iban", F.regexp_replace(m, " ", ""))
        .when(F.col("kind") == "phone", F.when(m.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits)))
        .when(F.col("kind").isin("phone_plus", "ssn"), digits)
        .when(F.col("kind") == "card", F.regexp_replace(_card(m), r"\D", ""))
        .when(F.col("kind").isin(*NAMED), F.lower(bare))
        .otherwise(m)
    )
    rows = mentions.select("mention", kind.alias("kind")).where("kind IS NOT NULL").withColumn("norm", norm)
    rows = rows.where("norm IS NOT NULL")
    return rows.withColumn("kind", F.when(F.col("kind") == "phone_plus", "phone").otherwise(F.col("kind")))


def _stream(*parts: Column | str, block: Column | None = None) -> Column:
    """128 hexadecimal digits, keyed; others for each ``block``."""
    key = F.concat_ws("|", F.lit(KEY), *parts)
    first = F.lit(0) if block is None else block * 2
    half = [F.sha2(F.concat(key, F.lit("|"), (first + i).cast("string")), 256) for i in (0, 1)]
    return F.concat(*half)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


_ALPHABETS = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _wider(letters: str) -> Column:
    """What is appended to the surrogate of ``kind, norm`` at ``attempt``: nothing before ``WIDEN``."""
    stream = _stream("kind", "norm", F.col("attempt").cast("string"), F.lit("wider"))
    many = F.greatest(F.lit(0), F.col("attempt") - (WIDEN - 1))
    picked = F.transform(
        F.sequence(F.lit(0), many),
        lambda i: F.when(i < many, F.substring(F.lit(letters), _byte(stream, i) % len(letters) + 1, F.lit(1))).otherwise(""),
    )
    return F.array_join(picked, "")


def _same_shape(text: Column, *parts: Column | str, hexadecimal: Column | None = None) -> Column:
    """Each digit and letter replaced by one of its class, by the streams of ``parts``, one for each 64
    characters; in hexadecimal texts letters stay below g."""

    def one(c: Column, i: Column, stream: Column) -> Column:
        out = c
        for pattern, letters in _ALPHABETS:
            n = F.lit(len(letters)) if hexadecimal is None or letters[0] == "0" else F.when(hexadecimal, 6).otherwise(len(letters))
            out = F.when(c.rlike(pattern), F.substring(F.lit(letters), _byte(stream, i) % n + 1, F.lit(1))).otherwise(out)
        return out

    def block(chunk: Column, j: Column) -> Column:
        shaped = F.transform(
            F.array(_stream(*parts, block=j)),
            lambda stream: F.array_join(F.transform(F.split(chunk, ""), lambda c, i: one(c, i, stream)), ""),
        )
        return shaped[0]

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,64}"), F.lit(0)), block), "")


#: Syllables and endings that names are made from, per script and gender.
_NAMES = {
    "latin": ("ba be bo da de do fa fe ga go ha ka ke la le lo ma me mi mo na ne no pa ra re ro sa se so ta te to va ve vi".split(),
              "na la ra ta".split(), "n r s k".split()),
    "cyrillic": ("ба бе бо да де до ва ве га го жа за зе ка ко ла ле ло ма ме ми мо на не но па ра ре ро са се со та те то".split(),
                 "на ла ра та".split(), "н р с к".split()),
}


def _name(norm: Column, kind: Column, stream: Column) -> Column:
    """A name of as many parts as ``norm``, in lower case, with the ending of the gender."""

    def of_script(script: str) -> Column:
        syllables, woman, man = (F.array(*map(F.lit, x)) for x in _NAMES[script])

        def part(_: Column, i: Column) -> Column:
            pick = [
                F.element_at(syllables, _byte(stream, i * 8 + j) % len(_NAMES[script][0]) + 1) for j in range(4)
            ]
            end = F.when(kind == "woman", F.element_at(woman, _byte(stream, i * 8 + 5) % 4 + 1)).when(
                kind == "man", F.element_at(man, _byte(stream, i * 8 + 5) % 4 + 1)
            ).otherwise("")
            return F.concat(*pick, end)

        return F.array_join(F.transform(F.split(norm, " "), part), " ")

    return F.when(norm.rlike(r"\p{IsCyrillic}"), of_script("cyrillic")).otherwise(of_script("latin"))


def surrogate() -> Column:
    """The surrogate, in normal form, of ``kind, norm`` at ``attempt``."""
    kind, norm = F.col("kind"), F.col("norm")
    keyed = ("kind", "norm", F.col("attempt").cast("string"))
    stream, shaped = _stream(*keyed), _same_shape(norm, *keyed)
    digits, letters = _wider("0123456789"), _wider("0123456789abcdef")
    vowels = F.when(norm.rlike(r"\p{IsCyrillic}"), _wider("аеиоу")).otherwise(_wider("aeiou"))
    from_two = F.substring(F.lit("23456789"), _byte(stream, F.lit(60)) % 8 + 1, F.lit(1))
    code = F.regexp_extract(norm, _CODE, 1)
    phone = F.when(
        (F.length(norm) == 11) & (code == "1"),
        F.concat(F.lit("1"), from_two, F.substring(shaped, 3, 2), F.translate(F.substring(shaped, 5, 1), "01", "57"), F.substring(shaped, 6, 99)),
    ).otherwise(F.concat(code, F.substring(shaped, F.length(code) + 1, F.length(norm))))
    head = F.concat(F.substring(norm, 1, 1), F.substring(shaped, F.lit(2), F.length(norm) - 2), digits)
    card = F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10).cast("string"))
    local = F.substring_index(norm, "@", 1)
    domain = F.substring_index(norm, "@", -1)
    # A domain has one surrogate, whatever stands before it; later rounds change and widen the local part alone.
    hidden = _same_shape(domain, F.lit("domain"), domain)
    email = F.concat(_same_shape(local, *keyed), letters, F.lit("@"), hidden, F.lit(".example"))
    octets = [
        F.when(F.col("attempt") < 8, _byte(stream, F.lit(0)) % 15 + 240).otherwise(_byte(stream, F.lit(0)) % 223 + 1),
        *(_byte(stream, F.lit(i)) for i in (1, 2, 3)),
    ]
    return (
        F.when(kind == "email", email)
        .when(kind == "phone", F.concat(phone, digits))
        .when(kind == "card", card)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(shaped, 2, 99), digits))
        .when(kind == "ipv4", F.concat_ws(".", *(o.cast("string") for o in octets)))
        .when(kind.isin("access_key", "iban"), F.concat(F.substring(norm, 1, F.when(kind == "iban", F.lit(2)).otherwise(F.lit(4))), _same_shape(F.substring(norm, F.when(kind == "iban", F.lit(3)).otherwise(F.lit(5)), F.lit(99)), *keyed), digits))
        .when(kind == "secret", F.concat(_same_shape(norm, *keyed, hexadecimal=norm.rlike("^[0-9a-f]+$")), letters))
        .otherwise(F.concat(vowels, _name(norm, kind, stream)))
    )


def surrogates(entities: DataFrame) -> DataFrame:
    """``kind, norm, surrogate`` of distinct ``kind, norm``: all different within a kind, none of them real."""
    spark = entities.sparkSession
    known = stage_table(spark, entities.select("kind", "norm").distinct(), "entities")
    rows = stage_table(
        spark, known.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate()), "surrogates"
    )
    while True:
        first = F.min(F.struct("attempt", "norm")).alias("first")
        shared = rows.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
        shared = shared.select("kind", "surrogate", F.col("first.norm").alias("keeps"))
        real = known.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
        state = rows.join(shared, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        clash = F.coalesce("real", F.lit(False)) | (F.col("keeps").isNotNull() & (F.col("keeps") != F.col("norm")))
        state = stage_table(spark, state.select("kind", "norm", "attempt", "surrogate", clash.alias("clash")), "clashes")
        if state.where("clash").isEmpty():
            return state.select("kind", "norm", "surrogate")
        state = state.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int"))
        rows = state.withColumn("surrogate", F.when(F.col("clash"), surrogate()).otherwise(F.col("surrogate")))
        rows = stage_table(spark, rows.select("kind", "norm", "attempt", "surrogate"), "surrogates")


def _in_format(mention: Column, digits: Column) -> Column:
    """``mention`` with its digits replaced, in order, by ``digits``; those left over follow its last digit."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("i"))
    return F.aggregate(
        F.split(mention, ""), start,
        lambda a, c: F.when(
            c.rlike("[0-9]"),
            F.struct(F.concat(a["o"], F.substring(digits, a["i"], F.lit(1))).alias("o"), (a["i"] + 1).alias("i")),
        ).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["i"].alias("i"))),
        lambda a: F.concat(a["o"], F.substring(digits, a["i"], F.length(digits))),
    )


def rendered() -> Column:
    """The surrogate of a mention in the mention's own format."""
    m, kind, s = (F.col(c) for c in ("mention", "kind", "surrogate"))
    local = (kind == "phone") & ~m.startswith("+")
    card = _card(m)
    at = F.position(card, m)
    value = F.regexp_extract(m, _VALUE, 1), F.regexp_extract(m, _VALUE, 3)
    upper = m == F.upper(m)
    iban = F.aggregate(
        F.split(m, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("i")),
        lambda a, c: F.when(c == " ", F.struct(F.concat(a["o"], c).alias("o"), a["i"].alias("i"))).otherwise(
            F.struct(F.concat(a["o"], F.substring(s, a["i"], F.lit(1))).alias("o"), (a["i"] + 1).alias("i"))
        ),
        lambda a: F.concat(a["o"], F.substring(s, a["i"], F.length(s))),
    )
    return (
        F.when(kind == "ipv4", s)
        .when(kind == "card", F.concat(F.substring(m, F.lit(1), at - 1), _in_format(card, s), F.substring(m, at + F.length(card), F.length(m))))
        .when(kind.isin("phone", "ssn"), _in_format(m, F.when(local, F.substring(s, F.lit(2), F.length(s))).otherwise(s)))
        .when(kind == "secret", F.concat(value[0], s, value[1]))
        .when(kind == "email", F.when(upper, F.upper(s)).otherwise(s))
        .when(kind == "iban", iban)
        .when(kind == "access_key", s)
    )


def _core(word: Column) -> Column:
    return F.regexp_replace(word, _TAIL, "")


def _name_words(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, r"^\S+ ", ""), " ")


def _renamed(word: Column, kind: Column, names: Column) -> Column:
    """``word`` with the name in it replaced in its own case; null if ``names`` lacks it."""
    core = _core(word)
    new = F.element_at(names, F.concat(kind, F.lit("|"), F.lower(core)))
    new = F.when((F.length(core) > 1) & (core == F.upper(core)), F.upper(new)).otherwise(F.initcap(new))
    return F.concat(new, F.substring(word, F.length(core) + 1, F.length(word)))


def _renamed_mention(mention: Column, names: Column) -> Column:
    kind = F.when(mention.rlike(f"^(?:{PATTERNS['woman']})$"), "woman").when(mention.rlike(f"^(?:{PATTERNS['man']})$"), "man")
    words = F.transform(_name_words(mention), lambda w: F.coalesce(_renamed(w, F.coalesce(kind, F.lit("")), names), w))
    named = F.regexp_extract(mention, r"^(\S+ )", 1)
    is_name = kind.isNotNull() | mention.rlike(f"^(?:{PATTERNS['person']})$")
    return F.when((F.size(names) > 0) & is_name, F.concat(named, F.array_join(words, " ")))


def _names_of_texts(each: DataFrame, mentions: DataFrame, names: DataFrame) -> DataFrame:
    """``_key, mention, to``: ``kind|part`` of every name part of a text, and ``|part`` for mentions without gender."""
    named = mentions.where(F.col("kind").isin(*NAMED))
    parts = each.join(named.select("mention", "kind"), "mention").select("_key", "kind", F.explode(_name_words(F.col("mention"))).alias("word"))
    parts = parts.select("_key", "kind", F.lower(_core(F.col("word"))).alias("norm")).distinct().join(names, ["kind", "norm"])
    own = parts.where("kind != 'person'").select("_key", F.concat_ws("|", "kind", "norm").alias("mention"), F.col("surrogate").alias("to"))
    best = F.min(F.struct(F.col("kind") == "person", "kind", "surrogate"))["surrogate"].alias("to")
    bare = parts.groupBy("_key", "norm").agg(best)
    return own.union(bare.select("_key", F.concat(F.lit("|"), F.col("norm")).alias("mention"), "to"))


def replaced(docs: DataFrame) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``: how many mentions were replaced.

    A matching text is cut at its mentions and put together again, so only mentions change. ``n_chars``
    follows the new text where it changed.
    """
    spark = docs.sparkSession
    own, extra = [c for c in docs.columns if c != "n_entities"], F.lit(0).alias("n_entities")
    quick = F.coalesce(may_have_entity(F.col("text")), F.lit(False))
    key = node_key("text").alias("_key")
    found = docs.where(quick).select(key, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("mentions"))
    found = stage_table(spark, found.where(F.size("mentions") > 0), "mentions")
    each = found.select("_key", F.explode(F.array_distinct("mentions")).alias("mention")).distinct()
    mentions = stage_table(spark, classified(each.select("mention").distinct()), "classified")
    is_name = F.col("kind").isin(*NAMED)
    parts = mentions.where(is_name).select("kind", F.explode(_name_words(F.col("mention"))).alias("word"))
    parts = parts.select("kind", F.lower(_core(F.col("word"))).alias("norm"))
    names = surrogates(mentions.where(~is_name).select("kind", "norm").union(parts))
    table = mentions.where(~is_name).join(names, ["kind", "norm"]).select("mention", rendered().alias("to"))
    table = stage_table(spark, table, "replacements")
    rows = each.join(table, "mention").select("_key", "mention", "to", F.lit(False).alias("name"))
    rows = rows.union(_names_of_texts(each, mentions, names).withColumn("name", F.lit(True)))
    entry = F.struct("mention", "to")
    by_text = rows.groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.when(~F.col("name"), entry))).alias("_to"),
        F.map_from_entries(F.collect_list(F.when(F.col("name"), entry))).alias("_names"),
    )
    by_text = stage_table(spark, by_text, "by_text")

    def put_together(x: Column) -> Column:
        # Names found after a form of address are replaced wherever else they stand in the text.
        words = lambda part: F.regexp_extract_all(part, F.lit(f"{_LETTER}+|[^\\p{{L}}'’-]+"), F.lit(0))
        again = lambda w: F.when(w.rlike(r"^\p{Lu}.") & (F.length(_core(w)) > 1), _renamed(w, F.lit(""), x["names"]))
        bare = F.transform(
            x["parts"],
            lambda part: F.when(
                F.size(x["names"]) > 0,
                F.array_join(F.transform(words(part), lambda w: F.coalesce(again(w), w)), ""),
            ).otherwise(part),
        )
        n_bare = F.when(
            F.size(x["names"]) > 0,
            F.aggregate(
                x["parts"], F.lit(0), lambda n, part: n + F.size(F.filter(words(part), lambda w: again(w).isNotNull()))
            ),
        ).otherwise(0)
        to = F.transform(
            x["mentions"], lambda m: F.coalesce(F.element_at(x["to"], m), _renamed_mention(m, x["names"]))
        )
        kept = F.zip_with(to, x["mentions"], lambda new, m: F.coalesce(new, m))
        new = F.zip_with(bare, kept, lambda part, m: F.concat(part, F.coalesce(m, F.lit(""))))
        return F.struct(
            F.array_join(new, "").alias("text"), (F.size(F.filter(to, lambda t: t.isNotNull())) + n_bare).alias("n")
        )

    cut = F.struct(
        F.split("text", ANY, -1).alias("parts"),
        F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("mentions"), F.col("_to").alias("to"),
        F.col("_names").alias("names"),
    )
    row = F.struct(*own).alias("row")  # so that no column of the documents clashes
    some = docs.where(quick).select(row, key, "text").join(by_text.hint("merge"), "_key", "left")
    some = some.withColumn("_new", F.when(F.col("_to").isNotNull(), F.transform(F.array(cut), put_together)[0]))
    changed = {c: F.col("row")[c] for c in own}
    changed["text"] = F.coalesce("_new.text", "row.text")
    if "n_chars" in own:
        changed["n_chars"] = F.when(F.col("_new").isNotNull(), F.length("_new.text")).otherwise(
            F.col("row.n_chars")
        ).cast(docs.schema["n_chars"].dataType)
    count = F.coalesce("_new.n", F.lit(0)).alias("n_entities")
    some = some.select(*(value.alias(c) for c, value in changed.items()), count)
    return docs.where(~quick).select(*own, extra).union(some)


def without_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with surrogates in ``text`` and all columns as before."""
    names = docs.columns
    if "n_entities" in names:  # a column of the documents, not the count
        return replaced(docs.withColumnRenamed("n_entities", "_n_entities")).drop("n_entities").withColumnRenamed(
            "_n_entities", "n_entities"
        ).select(*names)
    return replaced(docs).select(*names)
