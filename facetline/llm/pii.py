"""Personal data and secrets: detection and keyed, type-consistent surrogates. DataFrame functions only."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetline.llm.common import read
from facetline.session import Scratch

#: Where a session names the key; one that nobody else knows, or surrogates of short things can be found by trying all.
KEY_CONF = "spark.facetline.surrogate.key"

#: Forms of address by gender; fixed values.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "Κυρία"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Κύριος"]
NEUTRAL = ["Dr", "Prof"]
_TITLES = "(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.?\s"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: What is looked for, first match first; fixed values. Each is tried only where such a thing can begin.
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s*[=:]\s*[\"']?[^\s\"']{6,}+",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}+",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,6}}{_HEX}|(?:{_HEX}:){{2,7}}:)(?![0-9A-Za-z:])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": rf"(?<![\p{{L}}]){_TITLES}{_NAME}(?: {_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No pattern matches a text without one of these: a cheap test first.
HINT = "[0-9@]|(?i:pass|pwd|secret|token|key)|" + "|".join(sorted({t for t in FEMALE + MALE + NEUTRAL}))

_SCRIPTS = {
    "\\p{IsCyrillic}": ("бвгдклмнпрст", "аеиоу"),
    "\\p{IsGreek}": ("βγδκλμνπρστ", "αειοη"),
    "\\p{IsArmenian}": ("բգդկլմնպրստ", "աեիօ"),
    "": ("bdfgklmnprstv", "aeiou"),
}
_ENDS = {"\\p{IsCyrillic}": ("на", "м"), "\\p{IsGreek}": ("να", "ς"), "\\p{IsArmenian}": ("նա", "ն"), "": ("na", "n")}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def mentions(text: Column) -> Column:
    """All matches of a text, in order; none for null."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{p})$"), k) for k, p in PATTERNS.items()], F.lit("secret"))


def parts_of(mention: Column) -> Column:
    """array<struct<prefix, kind, canon, shown, gender>>: a mention is its parts, each after a prefix that stays. canon is
    the same for all ways to write one thing, so that surrogates agree: digits alone, e-mail in lower case, name by name.
    Of several names the last is the family's; gender is that of the form of address: f, m or null."""
    kind = kind_of(mention)

    none = F.lit(None).cast("string")

    def part(prefix: Column, k: Column, canon: Column, shown: Column, gender: Column = none) -> Column:
        return F.struct(prefix.alias("prefix"), k.alias("kind"), canon.alias("canon"), shown.alias("shown"), gender.alias("gender"))

    empty = F.lit("")
    before = F.regexp_extract(mention, r"^(?is)(.*?[=:]\s*[\"']?)", 1)
    value = F.substring(mention, F.length(before) + 1, F.length(mention))
    title = F.regexp_extract(mention, f"^({_TITLES})", 1)
    name = F.substring(mention, F.length(title) + 1, F.length(mention))
    bare = F.regexp_replace(title, r"[.\s]", "")
    gender = F.when(bare.isin(FEMALE), "f").when(bare.isin(MALE), "m")
    words = F.split(name, " ")

    def word(w: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        return part(F.when(i == 0, title).otherwise(F.lit(" ")), F.when(last, "family").otherwise("given"), F.lower(w), w, F.when(~last, gender))

    names = F.transform(words, word)
    return (
        F.when(kind == "secret", F.array(part(before, kind, value, value)))
        .when(kind == "name", names)
        .when(kind == "email", F.array(part(empty, kind, F.lower(mention), mention)))
        .when(kind == "ip6", F.array(part(empty, kind, F.lower(mention), mention)))
        .when(kind.isin("card", "ssn", "phone"), F.array(part(empty, kind, _digits(mention), mention)))
        .when(kind == "iban", F.array(part(empty, kind, F.replace(mention, F.lit(" ")), mention)))
        .otherwise(F.array(part(empty, kind, mention, mention)))
    )


def _byte(i: str) -> str:
    return f"cast(conv(substr(hash, pmod(2 * ({i}), 254) + 1, 2), 16, 10) as int)"


def _chars(keep: str = "false") -> str:
    """Each character of canon by one of its class from the hash; where keep holds (of c and i), itself."""
    return f"""array_join(transform(sequence(1, length(canon)), i -> case
      when {keep.replace('c.', 'substr(canon, i, 1)')} then substr(canon, i, 1)
      when substr(canon, i, 1) rlike '[0-9]' then cast(pmod({_byte('i')}, 10) as string)
      when substr(canon, i, 1) rlike '[a-f]' and canon rlike '^[0-9a-f]+$' then substr('abcdef', pmod({_byte('i')}, 6) + 1, 1)
      when substr(canon, i, 1) rlike '[a-z]' then char(97 + pmod({_byte('i')}, 26))
      when substr(canon, i, 1) rlike '[A-Z]' then char(65 + pmod({_byte('i')}, 26))
      else substr(canon, i, 1) end), '')"""


def _luhn(digits: str) -> str:
    """The sum that a check digit brings to a multiple of ten, over digits that it follows."""
    return f"aggregate(transform(sequence(1, length({digits})), i -> cast(substr({digits}, -i, 1) as int) * if(i % 2 = 1, 2, 1)), 0, (s, x) -> s + if(x > 9, x - 9, x))"


def _name(kind: str, gender: str, script: str) -> str:
    cons, vow = _SCRIPTS[script]
    end = {"f": _ENDS[script][0], "m": _ENDS[script][1]}.get(gender, "")
    length = 2 if kind == "given" else 3
    return f"""concat(array_join(transform(sequence(1, {length} + cast(attempt div 3 as int)), i -> concat(
      substr('{cons}', pmod({_byte('2 * i')}, {len(cons)}) + 1, 1), substr('{vow}', pmod({_byte('2 * i + 1')}, {len(vow)}) + 1, 1))), ''), '{end}')"""


def surrogate() -> Column:
    """Of canon by kind, from the columns kind, canon, gender, hash and attempt: the same type, format, script and gender."""
    octet = f"""array_join(transform(split(canon, '[.]'), (o, i) -> cast(case length(o)
      when 3 then 100 + pmod({_byte('i + 7')}, 156) when 2 then 10 + pmod({_byte('i + 7')}, 90) else 1 + pmod({_byte('i + 7')}, 9) end as string)), '.')"""
    number = "array_join(transform(sequence(1, length(canon)), i -> cast(if(substr(canon, i, 1) in ('0', '1'), pmod({0}, 10), 2 + pmod({0}, 8)) as string)), '')".format(_byte("i"))
    phone = f"concat(substr(canon, 1, if(length(canon) > 10, length(canon) - 10, 0)), substr({number}, if(length(canon) > 10, length(canon) - 10, 0) + 1))"
    head = f"concat(substr(canon, 1, 1), substr({number}, 2, length(canon) - 2))"
    check = f"cast(pmod(10 - pmod({_luhn(head)}, 10), 10) as string)"
    valid = f"pmod({_luhn('substr(canon, 1, length(canon) - 1)')} + cast(substr(canon, -1) as int), 10) = 0"
    card = f"if({valid}, concat({head}, {check}), {number})"
    names = "".join(
        f" when kind = '{k}'" + (f" and gender = '{g}'" if g else "") + (f" and canon rlike '{s.replace(chr(92), chr(92) * 2)}'" if s else "") + f" then {_name(k, g, s)}"
        for k, g in (("given", "f"), ("given", "m"), ("given", ""), ("family", ""))
        for s in _SCRIPTS
    )
    hexa = f"""array_join(transform(sequence(1, length(canon)), i -> if(substr(canon, i, 1) = ':', ':', substr('123456789abcdef', pmod({_byte('i')}, 15) + 1, 1))), '')"""
    # the check digits bring the number, letters as 10 to 35 and the first four characters last, to 1 modulo 97
    bank = f"substr({_chars('i <= 2')}, 5)"
    rest = f"aggregate(split(concat({bank}, substr(canon, 1, 2), '00'), ''), 0, (r, c) -> case when c = '' then r when c rlike '[0-9]' then (r * 10 + cast(c as int)) % 97 else (r * 100 + ascii(c) - 55) % 97 end)"
    iban = f"concat(substr(canon, 1, 2), lpad(cast(98 - {rest} as string), 2, '0'), {bank})"
    return F.expr(f"""case when kind = 'ip' then {octet} when kind = 'phone' then {phone} when kind = 'ssn' then {number} when kind = 'card' then {card}
      when kind = 'email' then {_chars("i > length(canon) - length(regexp_extract(canon, '([.][a-z]+)$', 1))")}
      when kind = 'ip6' then {hexa} when kind = 'key' then {_chars('i <= 4')} when kind = 'iban' then {iban}{names} else {_chars()} end""")


def _hash(key: str) -> Column:
    seed = [F.lit(key), F.col("kind"), F.col("canon"), F.col("attempt").cast("string")]
    return F.concat(*[F.sha2(F.concat_ws("\x1f", *seed, F.lit(str(j))), 256) for j in range(4)])


def surrogates(scratch: Scratch, things: DataFrame, key: str) -> DataFrame:
    """(kind, canon, fake) for the distinct (kind, canon, gender): no two of a kind share a fake, and none is a real one.

    Where fakes collide, the smallest keeps it and the others try again; each round is one written table. Where a format
    leaves no room (all that it can spell is taken), the number of tries shows in the fake, so that rounds end.
    """
    made = things.select("kind", "canon", "gender", F.lit(0).alias("attempt"))
    while True:
        fake = surrogate()
        spent = F.when(F.col("attempt") > 40, F.concat(F.lit("-"), F.col("attempt").cast("string"))).otherwise("")
        made = scratch.cut(made.withColumn("hash", _hash(key)).withColumn("fake", F.concat(fake, spent)).drop("hash"))
        # what one writes in several formats is one real thing: reals are compared as canon too
        owner = made.groupBy("kind", "fake").agg(F.min("canon").alias("owner"), F.count("*").alias("n"))
        reals = made.select("kind", F.col("canon").alias("fake")).distinct().withColumn("real", F.lit(True))
        clash = owner.join(reals, ["kind", "fake"], "left").where("n > 1 or real").select("kind", "fake", F.when(F.col("real").isNull(), F.col("owner")).alias("owner"))
        clash = scratch.cut(clash)
        if clash.isEmpty():
            return made.select("kind", "canon", "fake")
        made = _again(made, clash)


def _again(made: DataFrame, clash: DataFrame) -> DataFrame:
    hit = made.join(clash.withColumn("hit", F.lit(True)), ["kind", "fake"], "left")
    again = F.col("hit").isNotNull() & ~F.col("owner").eqNullSafe(F.col("canon"))
    return hit.select("kind", "canon", "gender", (F.col("attempt") + again.cast("int")).alias("attempt"))


def rendered() -> Column:
    """fake in the format of shown: digits into the places of digits, capitals where shown has them."""
    digits = """array_join(transform(sequence(1, length(shown)), i -> if(substr(shown, i, 1) rlike '[0-9]',
      substr(fake, length(regexp_replace(substr(shown, 1, i), '[^0-9]', '')), 1), substr(shown, i, 1))), '')"""
    cased = """array_join(transform(sequence(1, length(fake)), i -> if(substr(shown, i, 1) rlike '[A-Z]', upper(substr(fake, i, 1)), substr(fake, i, 1))), '')"""
    spaced = """array_join(transform(sequence(1, length(shown)), i -> if(substr(shown, i, 1) = ' ', ' ', substr(fake, length(replace(substr(shown, 1, i), ' ', '')), 1))), '')"""
    name = "if(shown = upper(shown), upper(fake), concat(upper(substr(fake, 1, 1)), substr(fake, 2)))"
    hexa = "if(shown rlike '[A-F]', upper(fake), fake)"
    return F.expr(f"case when kind in ('phone', 'card', 'ssn') then {digits} when kind = 'email' then {cased} when kind = 'iban' then {spaced} when kind = 'ip6' then {hexa} when kind in ('family', 'given') then {name} else fake end")


_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key that the session names in KEY_CONF; else a random one for this application, which nobody can repeat."""
    app = spark.sparkContext.applicationId
    return spark.conf.get(KEY_CONF, None) or _keys.setdefault(app, secrets.token_hex(32))


def replace_private(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with private data in text replaced; with found, an array column of struct<kind, surrogate> is added.

    Surrogates depend on the key and the thing only (and on what they would collide with), so one person or number has
    one surrogate in all documents, and different ones differ. Names are found after forms of address; where a text has
    one, its names are replaced wherever else they stand in the text as words. A given name has one surrogate whatever
    the form of address: of the gender that the forms of all texts agree on, else of none. Rows without matches pass
    unchanged, null texts too; repeated rows are replaced alike; no rows give no rows. Rows with matches are written once,
    joined by a row number with their own replacements, which are bounded by the text's length.
    """
    if not key:
        raise ValueError("surrogates need a key")
    scratch = Scratch(docs.sparkSession, "pii")
    names = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    t = F.col(f"c{names.index(text)}")
    kind = "array<struct<kind:string,surrogate:string>>"
    has = F.coalesce(t.rlike(HINT) & t.rlike(ANY), F.lit(False))
    clean = flat.where(~has).withColumn("found", F.array().cast(kind))
    hits = scratch.cut(flat.where(has).withColumn("rid", F.monotonically_increasing_id()))
    spots = hits.select("rid", F.posexplode(mentions(t)).alias("pos", "mention"))
    parts = scratch.cut(spots.select("rid", "pos", F.posexplode(parts_of(F.col("mention"))).alias("nth", "p")).select("rid", "pos", "nth", "p.*"))
    agreed = F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender")
    fakes = surrogates(scratch, parts.groupBy("kind", "canon").agg(agreed), key)
    done = parts.join(fakes, ["kind", "canon"]).withColumn("own", rendered()).withColumn("new", F.concat("prefix", "own"))
    word = F.concat(F.lit(r"(?<!\p{L})"), "shown", F.lit(r"(?!\p{L})"))
    again = F.when(F.col("kind").isin("given", "family"), F.struct((-F.length("shown")).alias("o"), word.alias("word"), F.col("own")))
    done = done.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "nth", "new", "kind", F.col("fake").alias("surrogate")))).alias("done"), F.array_sort(F.collect_set(again)).alias("people"))
    pieces = F.split(t, ANY, -1)
    bare = F.expr("if(size(people) = 0, pieces, transform(pieces, p -> aggregate(people, p, (s, x) -> regexp_replace(s, x.word, x.own))))")
    by_place = F.expr("transform(sequence(0, size(pieces) - 1), i -> concat(pieces[i], array_join(transform(filter(done, d -> d.pos = i), d -> d.new), '')))")
    hidden = hits.join(done, "rid").withColumn("pieces", pieces).withColumn("pieces", bare).withColumn(f"c{names.index(text)}", F.array_join(by_place, ""))
    hidden = hidden.withColumn("found", F.expr("transform(done, d -> named_struct('kind', d.kind, 'surrogate', d.surrogate))"))
    out = clean.unionByName(hidden.select(clean.columns))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != found], *([F.col("found").alias(found)] if found else []))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = replace_private(docs, session_key(spark), found="entities")
    return out.select("doc_id", F.size("entities").cast("bigint").alias("n_entities"), "text", "entities")
