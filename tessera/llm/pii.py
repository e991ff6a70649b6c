"""Surrogates for personal data, in SQL expressions.

Entities are found by one regex; each becomes a keyed surrogate of its own kind and format. A
surrogate follows from the key and the identity (an e-mail without letter case, a phone number's
digits, a surname apart from its title), so that mentions of one identity stay together; distinct identities of
the whole table are checked for equal surrogates, and for surrogates that are some other
identity, and those get another attempt until none collide.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import stored

# The regex of each kind, in order of precedence, and the names by gender.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "intl": r"(?<![\w.+])\+(?=(?:[ ./()-]{0,2}\d){8,15}(?![ ./()-]?\d))\d{1,3}(?:[ ./()-]{0,2}\d{1,4}){2,7}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra|Señor|Señora|Г-н|Г-жа)\.? \p{Lu}[\p{Ll}]+(?: \p{Lu}[\p{Ll}]+)?",
}
WOMEN = ["Anna", "Clara", "Elena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Sofia"]
MEN = ["Adam", "Bruno", "Carl", "David", "Felix", "Hugo", "Martin", "Oscar", "Paul", "Victor"]
WOMEN_CYRILLIC = ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"]
MEN_CYRILLIC = ["Антон", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел"]
SYLLABLES = ["ba", "den", "fir", "gal", "hol", "kes", "lin", "mor", "nel", "pas", "rad", "sten", "tor", "val", "wen", "zim"]
SYLLABLES_CYRILLIC = ["ба", "ден", "фир", "гал", "хол", "кес", "лин", "мор", "нел", "пас", "рад", "стен", "тор", "вал", "вен", "зим"]
FEMALE_TITLE = r"^(Mrs|Ms|Miss|Frau|Madame|Mme|Sra|Señora|Г-жа)\b"

_ANY = "|".join(f"(?:{p})" for p in KINDS.values())
_HINT = r"[0-9@]|(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra|Señor|Señora|Г-н|Г-жа)\.? \p{Lu}"


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def parts_of(entity: Column, kind: Column) -> Column:
    """struct(role, part) of what is replaced of an entity: the whole of it, or of a name the surname and the given name."""
    words = F.split(entity, " ")
    given = F.concat(F.lit("given_"), F.when(entity.rlike(FEMALE_TITLE), "f").otherwise("m"))
    surname = F.struct(F.lit("surname").alias("role"), F.element_at(words, -1).alias("part"))
    names = F.when(F.size(words) > 2, F.array(surname, F.struct(given.alias("role"), words[1].alias("part")))).otherwise(F.array(surname))
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("role"), entity.alias("part"))))


def identity_of(part: Column, role: Column) -> Column:
    """What makes two mentions one: the role and the part without its format and letter case."""
    digits = F.regexp_replace(part, r"\D", "")
    plain = F.when(role == "phone", F.substring(digits, -10, 10)).when(role.isin("ssn", "card", "intl"), digits).when(role == "ip", part).otherwise(F.lower(part))
    return F.concat_ws(":", role, plain)


def _digits(seed: Column, n: int) -> Column:
    """n decimal digits from a seed (n up to 30)."""
    part = lambda k: F.lpad(F.pmod(F.xxhash64(F.sha2(F.concat(seed, F.lit(f"/{k}")), 256)), F.lit(10**15)).cast("string"), 15, "0")
    return F.substring(F.concat(part(0), part(1)), 1, n)


def _in_format(entity: Column, digits: Column) -> Column:
    """The digits in place of the entity's, from the right; all else as it was. Digits before the tenth from the right of a phone number's are its country code."""
    pieces = F.split(F.reverse(entity), "")
    at = lambda i: F.size(F.filter(F.slice(pieces, 1, i + 1), lambda c: c.rlike(r"\d")))
    flipped = F.reverse(digits)
    return F.reverse(F.array_join(F.transform(pieces, lambda c, i: F.when(c.rlike(r"\d") & (at(i) <= F.length(digits)), flipped.substr(at(i), F.lit(1))).otherwise(c)), ""))


def _luhn(body: Column) -> Column:
    """The check digit after these digits."""
    d = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(d, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string")


def _pick(values: list[str], seed: Column, salt: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(F.sha2(F.concat(seed, F.lit(salt)), 256)), F.lit(len(values))).cast("int") + 1)


def surrogate(part: Column, role: Column, seed: Column, attempt: Column) -> Column:
    """The replacement of a part by a seed: of its kind, gender, script and format."""
    all_digits = F.regexp_replace(part, r"\D", "")
    n = F.length(all_digits)
    # e-mail: letters and digits of the user replaced one by one, at least eight of them; a reserved domain
    user = F.substring_index(part, "@", 1)
    letters = F.translate(F.substring(F.sha2(F.concat(seed, F.lit("u")), 256), 1, 64), "0123456789", "ghijkmnpqr")
    email = F.concat(F.substring(letters, 1, 10), F.regexp_extract(user, r"[._+-]", 0), F.when(user.rlike(r"\d"), _digits(seed, 3)).otherwise(""), F.lit("@"), F.lit("mail.example.org"))
    phone = _in_format(part, F.concat(F.lit("2"), _digits(seed, 9)))
    # other countries: the digits of the country code stay
    code = F.length(F.regexp_extract(part, r"^\+(\d{1,3})(?!\d)", 1))
    intl = _in_format(part, F.substring(_digits(seed, 30), F.lit(1), n - F.when(code > 0, code).otherwise(2)))
    ssn = _in_format(part, F.concat(F.lit("9"), _digits(seed, 8)))
    body = F.concat(F.substring(all_digits, 1, 1), F.substring(_digits(seed, 30), F.lit(1), n - 2))
    valid = _luhn(F.substring(all_digits, F.lit(1), n - 1)) == F.substring(all_digits, -1, 1)
    card = _in_format(part, F.concat(body, F.when(valid, _luhn(body)).otherwise(_digits(F.concat(seed, F.lit("c")), 1))))
    # addresses of private networks stay there, others go to the range that is in nobody's use (240 to 254)
    octet = lambda k, most: F.pmod(F.xxhash64(F.concat(seed, F.lit(f"ip{k}"))), F.lit(most))
    first = F.when(part.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"), F.lit(10)).otherwise(octet(0, 15) + 240)
    ip = F.concat_ws(".", first.cast("string"), *[octet(k, 256).cast("string") for k in (1, 2, 3)])
    cyrillic = part.rlike(r"\p{IsCyrillic}")
    syllables = lambda k: F.when(cyrillic, F.concat(*[_pick(SYLLABLES_CYRILLIC, seed, f"l{j}") for j in range(k)])).otherwise(F.concat(*[_pick(SYLLABLES, seed, f"l{j}") for j in range(k)]))
    # given names are common ones as far as those go, then longer ones that begin so
    women = F.when(cyrillic, _pick(WOMEN_CYRILLIC, seed, "f")).otherwise(_pick(WOMEN, seed, "f"))
    men = F.when(cyrillic, _pick(MEN_CYRILLIC, seed, "f")).otherwise(_pick(MEN, seed, "f"))
    given = F.concat(F.when(role == "given_f", women).otherwise(men), F.when(attempt > 0, syllables(4)).otherwise(""))
    return F.when(role == "email", email).when(role == "phone", phone).when(role == "intl", intl).when(role == "ssn", ssn).when(role == "card", card).when(role == "ip", ip).when(role == "surname", F.initcap(syllables(6))).otherwise(given)


def keyed(key: str, *message: Column | str) -> Column:
    """The HMAC-SHA256 of the message's parts, joined by |, as hex text."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(F.concat_ws("|", *message), "UTF-8")), 256))), 256)


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs with the entities of text_col replaced, and count_col, the number of them.

    Found are e-mails; phone numbers in the 3-3-4 grouping, and in any grouping after + and a country code (8 to
    15 digits); social security numbers (3-2-4); card numbers; IPv4 addresses; and names of one or two words after
    a title, which gives the gender. A surname has one surrogate whatever title or given name is in front
    of it, and a given name has one for each gender. Other forms stay as they are.

    All rows and columns stay, in any number of copies, whatever the columns' names (a column named count_col
    is replaced); a null text stays null with 0 entities, and an empty table stays empty. Surrogates differ
    for different identities of the table and are no identity that occurs in it: colliding identities (all
    but the one of smallest hash) try again until none are left; the job fails if 30 rounds in a
    row leave as many, for then a kind has more identities than surrogates.
    Only texts with entities are shuffled; the others pass through. Time is linear in a text's length: surrogates come by position.
    Surrogates follow from key; who has it and an identity can make them again.
    """
    text = F.col(text_col)
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    lists = stored(docs.select(F.sha2(text, 256).alias("t"), found.alias("entities")).where(F.size("entities") > 0).dropDuplicates(["t"]), "pii-lists")
    mentions = lists.select("t", F.posexplode("entities").alias("pos", "entity"))
    entities = stored(mentions.select("entity").distinct().withColumn("kind", kind_of(F.col("entity"))), "pii-kinds")
    parts = entities.select("entity", "kind", F.inline(parts_of(F.col("entity"), F.col("kind"))))
    parts = stored(parts.withColumn("identity", identity_of(F.col("part"), F.col("role"))), "pii-parts")
    known = stored(parts.groupBy("identity", "role").agg(F.min("part").alias("part"), F.lit(0).alias("attempt")), "pii-known")

    def seeded(rows: DataFrame) -> DataFrame:
        seed = keyed(key, F.col("identity"), F.col("attempt").cast("string"))
        return stored(rows.withColumn("seed", seed), "pii-seeds").withColumn("new", surrogate(F.col("part"), F.col("role"), F.col("seed"), F.col("attempt")))

    before, same = None, 0
    while True:
        tried = stored(seeded(known), "pii-tried").withColumn("new", identity_of(F.col("new"), F.col("role")))
        firsts = tried.groupBy("new").agg(F.min_by("identity", F.struct("attempt", F.xxhash64("identity"))).alias("first"))
        taken = known.select(F.col("identity").alias("new"), F.lit(True).alias("real"))
        judged = tried.join(firsts, "new").join(taken, "new", "left").where((F.col("identity") != F.col("first")) | F.col("real"))
        lost = stored(judged.select("identity", F.lit(1).alias("again")), "pii-lost")
        left = lost.count()
        if not left:
            break
        same = same + 1 if left == before else 0
        if same == 30:
            raise ValueError(f"{left} surrogates still collide: their kind has no more")
        before = left
        known = stored(known.join(lost, "identity", "left").select("identity", "role", "part", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "pii-known")
    new_parts = stored(seeded(parts.join(known.select("identity", "attempt"), "identity")), "pii-new-parts")
    title = F.regexp_extract("entity", r"^\S+", 0)
    one = lambda *roles: F.max(F.when(F.col("role").isin(*roles), F.col("new")))
    whole = new_parts.groupBy("entity", "kind").agg(one("given_f", "given_m").alias("given"), one("surname").alias("surname"), F.max("new").alias("new"))
    news = stored(whole.select("entity", F.when(F.col("kind") == "name", F.concat_ws(" ", title, "given", "surname")).otherwise(F.col("new")).alias("new")), "pii-new")
    listed = mentions.join(news, "entity").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("news"))
    listed = stored(listed.select(F.col("t").alias("of"), F.col("news.new").alias("news")), "pii-lists")
    # the table's columns are fields of one, so that no name of theirs meets one made here
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.coalesce(F.size(found), F.lit(0)).alias("n"))
    plain = row.where("n <= 0").select("row", "text", F.lit(0).alias("n"))
    some = row.where("n > 0").withColumn("t", F.sha2("text", 256)).join(listed, F.col("t") == F.col("of"))
    pieces = F.zip_with(F.split("text", _ANY, -1), "news", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    both = plain.union(some.select("row", F.array_join(pieces, ""), "n"))
    same = lambda a, b: a.lower() == b.lower()  # noqa: E731  as Spark compares names
    values = [F.col("text") if same(c, text_col) else F.col("n") if same(c, count_col) else F.col("row").getField(c) for c in docs.columns]
    out = [v.alias(c) for v, c in zip(values, docs.columns, strict=True)]
    return both.select(*out, *([] if any(same(c, count_col) for c in docs.columns) else [F.col("n").alias(count_col)]))
