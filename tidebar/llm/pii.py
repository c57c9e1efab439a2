"""Personal data replaced by keyed, type-consistent surrogates, with DataFrame and SQL functions only.

One pattern finds e-mail and IPv4 addresses, telephone numbers, card numbers, social security numbers, account numbers (IBAN), cloud
keys, values of passwords and tokens, and names after a title. An entity's surrogate follows from the secret key, its type and its
canonical form (digits of numbers, lower case of addresses), so the same entity gets the same surrogate in every document and every
spelling, in the format of that spelling: digits for digits, the letters of the same script and case, separators as they were,
country codes, card networks and account numbers with valid check digits, top-level domains, valid octets, names with the title's
gender. Domains are replaced consistently on their own, and so are surnames; a telephone number is the same entity with and without
its country code. Passwords are replaced at any length, other secrets from eight characters on;
those with fewer than eight letters and digits get twelve hexadecimal digits, as there are too few of their own format.

Collision checks keep entities apart: where two of one type would get one surrogate, or a surrogate is itself an entity of the
corpus (of a name, whatever the title), all but the smallest take their next surrogate, until none collide; the domains of addresses
are settled so before the addresses. Entities that took another attempt are few and are looked up; all others are computed in place,
so texts are not shuffled. The key is a parameter; the query takes it from the session's spark.tidebar.surrogate.key.

Null and empty texts stay as they are. Texts are read whole, in time linear in their length. Repeated rows get equal results, and of
colliding entities the one that sorts first keeps its surrogate. An empty table gives an empty result. Other columns are kept, also
where their names clash with those used inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

KEY = "change me"
#: Up to so many entities with another attempt are sent to every task (about 100 bytes each); more are joined by shuffling.
BROADCAST = 20_000
#: Digits of a telephone number after the country code.
NATIONAL = 10
TYPES = ("email", "ip", "phone", "card", "ssn", "iban", "key", "secret", "name")

# fixed values: titles by gender
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña", "госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof")

# fixed values: account numbers' lengths by country
IBANS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """Account numbers in groups of four or none: of a known country's length, else of 16 to 35 characters."""
    known = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBANS.items())
    # a last group of its own has a digit, so that a word in capitals that follows is none
    return rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z]{{2}}\d{{2}})(?:(?:{known})|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?:[A-Z0-9]{{1,3}}| (?=[A-Z]{{0,2}}\d)[A-Z0-9]{{1,3}})?)(?![\p{{L}}\p{{N}}])"


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET = r"(?i:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
# values of passwords have any length and signs; a value is no keyword with a value of its own
_PASSWORD = rf"(?i:password|passwd)\s{{0,3}}[=:]\s{{0,3}}[\"']?(?!{_SECRET})[^\s\"'<>&,;]{{0,}}[\p{{L}}\p{{N}}]"
_TITLE = rf"(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.?"
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
PATTERN = "|".join(
    [
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}[\p{L}\p{N}-]{2,24}",
        rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
        r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\p{L}\p{N}])",
        rf"(?<![\p{{L}}\p{{N}}])(?:{_PASSWORD}|{_SECRET}(?!{_SECRET})[A-Za-z0-9+/_.-]{{8,}}+)",
        _iban(),
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
        r"(?<![\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d)",
        r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
        rf"(?<![\p{{L}}\p{{N}}]){_TITLE} {_NAME}(?: {_NAME})?",
    ]
)


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with `name` standing for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def kind(e: str) -> str:
    return f"""case when {e} rlike {_lit(f'^{_SECRET}')} then 'secret' when instr({e}, '@') > 0 then 'email' when {e} rlike {_lit('^(?:AKIA|ASIA)')} then 'key'
        when {e} rlike {_lit(r'^\d{1,3}(?:\.\d{1,3}){3}$')} then 'ip' when {e} rlike {_lit('^[A-Z]{2}[0-9]{2}')} then 'iban' when {e} rlike {_lit(r'^\d{3}-\d{2}-\d{4}$')} then 'ssn'
        when {e} rlike {_lit('^[+(]')} then 'phone' when {e} rlike {_lit(r'^\p{L}')} then 'name' when length(regexp_replace({e}, '[^0-9]', '')) >= 13 then 'card' else 'phone' end"""


def _gender(e: str) -> str:
    of = lambda titles: _lit(rf"^(?:{'|'.join(titles)})\.? ")
    return f"case when {e} rlike {of(MALE)} then 'm' when {e} rlike {of(FEMALE)} then 'f' else 'n' end"


def canonical(e: str, k: str) -> str:
    return f"""case {k} when 'email' then lower({e}) when 'secret' then regexp_replace({e}, {_lit(f'^{_SECRET}')}, '')
        when 'phone' then right(regexp_replace({e}, '[^0-9]', ''), {NATIONAL}) when 'card' then regexp_replace({e}, '[^0-9]', '') when 'iban' then replace({e}, ' ', '')
        when 'name' then concat({_gender(e)}, ' ', lower(regexp_replace({e}, {_lit(f'^{_TITLE} ')}, ''))) else {e} end"""


def _held(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# What follows is built of columns: as SQL these expressions, nested as they are, leave the driver's parser with tens of megabytes of states.


def _seed(key: str, *parts: Column) -> Column:
    """240 hexadecimal digits that follow from the key and the parts."""
    said = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(F.sha2(said, 512), F.sha2(F.concat(said, F.lit("|more")), 512))


def _byte(s: Column, i: Column) -> Column:
    return F.conv(F.substring(s, 1 + 2 * F.pmod(i, F.lit(120)), F.lit(2)), 16, 10).cast("int")


def _nth(letters: str, b: Column) -> Column:
    return F.substring(F.lit(letters), 1 + F.pmod(b, F.lit(len(letters))), F.lit(1))


def _shape(x: Column, s: Column) -> Column:
    """x with every letter and digit replaced by one of its kind; s: hexadecimal digits."""

    def one(q: Column) -> Column:
        c, b = q["c"], q["b"]
        small, large = (F.char(F.lit(at) + F.pmod(b, F.lit(26))) for at in (97, 65))
        return (
            F.when(c.between("1", "9"), (1 + F.pmod(b, F.lit(9))).cast("string")).when(c == "0", F.pmod(b, F.lit(10)).cast("string"))
            .when(c.between("a", "z"), small).when(c.between("A", "Z"), large)
            .when(c.between("а", "я"), _nth("абвгдежзиклмнопрстуфхцчшэюя", b)).when(c.between("А", "Я"), _nth("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", b))
            .when(c.between("α", "ω"), _nth("αβγδεζηθικλμνξοπρστυφχψω", b)).when(c.between("Α", "Ω"), _nth("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", b))
            .when(c.rlike(r"^\p{Ll}"), small).when(c.rlike(r"^\p{Lu}"), large)
            .when(c.rlike(r"^\p{IsHan}"), _nth("安白成大方高光海和华江金林明平青山文新星雪阳永云", b)).when(c.rlike(r"^\p{L}"), small).otherwise(c)
        )

    letter = lambda i: _held(F.struct(F.substring(x, i, F.lit(1)).alias("c"), _byte(s, i).alias("b")), one)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), letter), "")


def _digits(s: Column, old: Column) -> Column:
    """Digits for digits, as many as old has; a digit that is not 0 stays so."""
    digit = lambda i: F.when(F.substring(old, i, F.lit(1)) == "0", F.pmod(_byte(s, i), F.lit(10)).cast("string")).otherwise((1 + F.pmod(_byte(s, i), F.lit(9))).cast("string"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(old)), digit), "")


def _luhn(d: Column, n: Column, upto: Column) -> Column:
    """The check sum of the first `upto` digits of a number of n digits."""

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return total + F.when(F.pmod(n - i, F.lit(2)) == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), upto), F.lit(0), add)


def _card(s: Column, c: Column) -> Column:
    new, n = F.concat(F.substring(c, 1, 1), F.substring(_digits(s, c), F.lit(2), F.length(c))), F.length(c)
    fixed = lambda d: F.concat(F.substring(d, F.lit(1), n - 1), F.pmod(10 - F.pmod(_luhn(d, n, n - 1), F.lit(10)), F.lit(10)).cast("string"))
    return _held(new, lambda d: F.when(F.pmod(_luhn(c, n, n), F.lit(10)) == 0, fixed(d)).otherwise(d))


def _mod97(x: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, capitals counting 10 to 35."""

    def add(total: Column, i: Column) -> Column:
        c = F.substring(x, i, F.lit(1))
        return F.when(c.between("0", "9"), F.pmod(total * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(total * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), add)


def _from(c: Column, at: int) -> Column:
    return F.substring(c, F.lit(at), F.length(c))


def _iban_of(s: Column, c: Column) -> Column:
    """Country, check digits that are right, and letters and digits for letters and digits."""
    land = F.substring(c, 1, 2)
    return _held(_shape(_from(c, 5), s), lambda d: F.concat(land, F.lpad((98 - _mod97(F.concat(d, land, F.lit("00")))).cast("string"), 2, "0"), d))


#: From this attempt on addresses, domains and surnames grow by a letter every so many attempts: short forms run out of surrogates.
GROW = 8


def _more(s: Column, n: Column) -> Column:
    letter = lambda i: F.char(97 + F.pmod(_byte(s, i), F.lit(26)))
    return F.when(n >= GROW, F.array_join(F.transform(F.sequence(F.lit(1), F.floor(n / GROW).cast("int")), letter), "")).otherwise("")


def _domain(key: str, domain: Column, n: Column) -> Column:
    """The n-th surrogate of a domain; what follows the last dot stays."""
    last = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    return F.concat(_held(_seed(key, F.lit("domain"), domain, n.cast("string")), lambda t: F.concat(_shape(labels, t), _more(t, n))), F.lit("."), last)


def _spoken(s: Column, at: int, name: Column, gender: Column, surname: bool) -> Column:
    """A name of two or three syllables in the script of the old one, with an ending of the gender."""
    byte = lambda i: _byte(s, F.lit(i))
    syllables = lambda text, one: F.concat(*(F.substring(F.lit(text), 1 + one * F.pmod(byte(at + j), F.lit(len(text) // one)), F.lit(one)) for j in range(3)))
    latin = syllables("barecidofugahalejikolumanepiqorusatevixowuyazebolera", 2)
    cyrillic = syllables("бавегидожузаикалемонупареситуфохацечишолюмя", 2)
    end = lambda f, m, n: F.when(gender == "f", f).when(gender == "m", m).otherwise(n)
    latin_end = end("a", "n", "s") if not surname else _nth("nrsl", byte(at + 4))
    cyrillic_end = end("на", "н", "ль") if not surname else end("ва", "в", "ко")
    return F.initcap(F.when(name.rlike(r"\p{IsCyrillic}"), F.concat(cyrillic, cyrillic_end)).otherwise(F.concat(latin, latin_end)))


def surrogate(key: str, k: Column, c: Column, n: Column, dn: Column) -> Column:
    """The n-th canonical surrogate of canonical form c of type k; dn: the attempt of an address's domain."""
    words, gender = F.split(_from(c, 3), " "), F.substring(c, 1, 1)
    last = F.element_at(words, -1)
    surname = _held(_seed(key, F.lit("surname"), last, n.cast("string")), lambda t: F.concat(_spoken(t, 1, last, gender, True), _more(t, n)))

    def body(s: Column) -> Column:
        shaped = _shape(c, s)
        email = F.concat(_shape(F.substring_index(c, "@", 1), s), _more(s, n), F.lit("@"), _domain(key, F.substring_index(c, "@", -1), dn))
        ip = F.concat_ws(".", *((1 + F.pmod(_byte(s, F.lit(i)), F.lit(254))).cast("string") for i in range(1, 5)))
        hexed = F.array_join(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.lower(F.hex(F.pmod(_byte(s, i), F.lit(16))))), "")
        secret = F.when(F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) < 8, F.substring(s, 1, 12)).when(c.rlike("^[0-9a-f]+$"), hexed).otherwise(shaped)
        name = F.concat_ws(" ", F.when(F.size(words) > 1, _spoken(s, 1, F.element_at(words, 1), gender, False)), surname)
        return (
            F.when(k == "email", email).when(k == "ip", ip).when(k == "phone", _digits(s, c)).when(k == "card", _card(s, c)).when(k == "ssn", shaped).when(k == "iban", _iban_of(s, c))
            .when(k == "domain", _domain(key, c, n)).when(k == "key", F.concat(F.substring(c, 1, 4), _shape(_from(c, 5), s))).when(k == "secret", secret).otherwise(name)
        )

    return _held(_seed(key, k, c, n.cast("string")), body)


def as_written(e: Column, k: Column, c: Column, new: Column) -> Column:
    """The canonical surrogate in the spelling of entity e."""
    # a number written with its country code keeps it
    digits = F.regexp_replace(e, "[^0-9]", "")
    whole = F.concat(F.substring(digits, F.lit(1), F.when(k == "phone", F.greatest(F.length(digits) - NATIONAL, F.lit(0))).otherwise(0)), new)
    sign = lambda i: F.substring(e, i, F.lit(1))
    placed = lambda w: F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: F.when(sign(i).rlike("[0-9A-Za-z]"), F.substring(w, F.length(F.regexp_replace(F.substring(e, F.lit(1), i), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(sign(i))), "")
    return (
        F.when(k.isin("phone", "card", "iban"), _held(whole, placed)).when(k == "secret", F.concat(F.substring(e, F.lit(1), F.length(e) - F.length(c)), new))
        .when(k == "name", F.concat(F.regexp_extract(e, f"^{_TITLE} ", 0), new)).otherwise(new)
    )


def entities(text: str) -> str:
    """SQL: the entities of a text in their order, as structs (e, k, c)."""
    found = f"regexp_extract_all({text}, {_lit(PATTERN)}, 0)"
    return f"transform({found}, e -> {_let('k', kind('e'), f'named_struct({_lit("e")}, e, {_lit("k")}, k, {_lit("c")}, {canonical("e", "k")})')})"


def _settled(all_: DataFrame, nth: Column) -> DataFrame | None:
    """(k, c, n) of the entities of all_ (k, c, dn, n, new) that take another attempt than the first; nth: the surrogate of a row."""
    said = lambda k, c: F.when(F.col(k) == "name", F.substring(c, 3, 10_000)).otherwise(F.col(c))  # noqa: E731  a name without its gender
    taken = all_.select("k", said("k", "c").alias("own")).distinct()
    moved = None
    while True:
        now = all_ if moved is None else all_.join(moved, ["k", "c"], "left_anti").unionByName(moved)
        # of those with one surrogate the smallest keeps it; nobody gets what somebody has
        shared = now.groupBy("k", "new").agg(F.count("*").alias("m"), F.min("c").alias("first")).where("m > 1").select("k", "new", "first")
        same = now.join(shared, ["k", "new"]).where("c != first").select("k", "c", "dn", "n")
        own = now.withColumn("own", F.when(F.col("k") == "name", F.lower("new")).otherwise(F.col("new"))).join(taken, ["k", "own"], "left_semi").select("k", "c", "dn", "n")
        clash = cut(same.unionByName(own).distinct())
        if clash.isEmpty():
            return moved
        again = clash.withColumn("n", F.col("n") + 1).withColumn("new", nth)
        moved = cut(again if moved is None else moved.join(again, ["k", "c"], "left_anti").unionByName(again))


def _attempts(found: DataFrame, key: str) -> DataFrame | None:
    """(k, c, n) of the entities, domains among them, that take another attempt than the first."""
    nth = surrogate(key, F.col("k"), F.col("c"), F.col("n"), F.col("dn"))
    first = lambda df: cut(df.withColumn("n", F.lit(0)).withColumn("new", nth).select("k", "c", "dn", "n", "new"))
    each = cut(found.select("k", "c").distinct())
    domain = F.when(F.col("k") == "email", F.substring_index("c", "@", -1))
    domains = _settled(first(each.where("k = 'email'").select(F.lit("domain").alias("k"), domain.alias("c"), F.lit(0).alias("dn")).distinct()), nth)
    if domains is None:
        each = each.withColumn("dn", F.lit(0))
    else:
        of = domains.select(F.col("c").alias("_domain"), F.col("n").alias("_n"))
        each = each.withColumn("_domain", domain).join(of, "_domain", "left").select("k", "c", F.coalesce("_n", F.lit(0)).alias("dn"))
    rest = _settled(first(each), nth)
    parts = [d.select("k", "c", "n") for d in (domains, rest) if d is not None]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def replace_personal_data(docs: DataFrame, text_col: str = "text", key: str = KEY, counts: bool = False) -> DataFrame:
    """docs with surrogates in the text; with counts, also n_entities and one count for each type."""
    names = docs.columns
    found = docs.select(F.explode(F.expr(entities(f"`{text_col}`"))).alias("x")).select("x.k", "x.c")
    moved = _attempts(found, key)
    # what is used inside goes into structs, so that no column of the input can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    rows = rows.withColumn("_found", F.expr(entities("_text")))
    if moved is None:
        rows = rows.withColumn("_again", F.expr("cast(map() as map<string, int>)"))
    elif moved.count() <= BROADCAST:
        whole = moved.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "k", "c"), "n"))).alias("_again"))
        rows = rows.crossJoin(F.broadcast(whole))  # one row, of checked size
    else:
        rows = rows.withColumn("_id", F.struct(F.xxhash64("_text"), F.hash("_text"), F.octet_length("_text")))
        mine = rows.select("_id", F.explode("_found").alias("x")).select("_id", "x.k", "x.c")
        mine = mine.unionByName(mine.where("k = 'email'").select("_id", F.lit("domain").alias("k"), F.substring_index("c", "@", -1).alias("c"))).distinct().join(moved, ["k", "c"])
        mine = mine.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "k", "c"), "n"))).alias("_again"))
        rows = rows.join(mine, "_id", "left")
    attempt = lambda kind, c: F.coalesce(F.element_at("_again", F.concat_ws("|", kind, c)), F.lit(0))

    def replaced(x: Column) -> Column:
        own, of_domain = attempt(x["k"], x["c"]), attempt(F.lit("domain"), F.substring_index(x["c"], "@", -1))
        return _held(surrogate(key, x["k"], x["c"], own, of_domain), lambda w: as_written(x["e"], x["k"], x["c"], w))

    parts = F.struct(F.split("_text", PATTERN, -1).alias("gap"), F.transform("_found", replaced).alias("new"))
    joined = _held(parts, lambda p: F.array_join(F.transform(p["gap"], lambda g, i: F.concat(g, F.coalesce(F.get(p["new"], i), F.lit("")))), ""))
    rows = rows.withColumn("_new", F.when(F.size("_found") > 0, joined).otherwise(F.col("_text")))
    out = [F.col("_new").alias(c) if c == text_col else F.length("_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in names]
    if counts:
        out += [F.coalesce(F.size("_found"), F.lit(0)).alias("n_entities"), *(F.expr(f"coalesce(size(filter(_found, x -> x.k = '{k}')), 0)").alias(f"n_{k}") for k in TYPES)]
    return rows.select(*out)


def op10_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.tidebar.surrogate.key", KEY)
    return replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key, counts=True)
