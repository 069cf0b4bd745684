"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one regular expression, in texts that a cheaper one lets through. Each has a normal form: a number's digits, an
address in small letters, a person's given and family name apart. The replacement is a keyed function of type and normal form,
written back in each mention's own format, so a person under two titles or a number in two spellings has one surrogate, in any document.
Later mentions of a titled person without the title are found in the same text. The replacement keeps the type, the length and punctuation of
the format, letter case and script, a number's checksum, and for given names the gender that the name or title tells. Replacements are then
checked over the whole corpus: two normal forms that would share one, or one that is itself somebody's, are drawn again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Forms of address by the gender they tell, and given names to know and to choose from, by script and gender.
TITLES = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Sir", "Lord", "Signor", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Lady", "Signora", "Госпожа"],
    "n": ["Dr", "Prof", "Mx", "Доктор"],
}
GIVEN = {
    ("latin", "m"): "Adam Anton Arthur Boris Bruno Carl Carlos David Diego Edward Emil Enrique Felix Frank Georg George Henry Hugo Ivan James Jean John Jonas José Juan Karl Leon Louis Luis Marco "
    "Martin Michael Miguel Nils Oscar Paul Pedro Peter Philip Pierre Rafael Richard Robert Stefan Thomas Victor Walter William".split(),
    ("latin", "f"): "Adele Agnes Alice Anna Beatriz Berta Carmen Catherine Charlotte Clara Diana Elena Elizabeth Emma Eva Fiona Frances Greta Hanna Helen Ingrid Irene Isabel Jane Julia Karla Laura "
    "Linda Lucia Margaret Maria Marie Martha Mary Monica Nadia Nora Olga Paula Pilar Rosa Sara Sophie Susan Teresa Ursula Vera".split(),
    ("latin", "n"): "Alex Robin Kim Sasha Jules Noel Charlie Dominique".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Олег".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ольга Нина".split(),
    ("cyrillic", "n"): "Саша Женя Валя".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро".split(),
}

_TITLE = "(?:" + "|".join(sorted((t for v in TITLES.values() for t in v), key=lambda t: (-len(t), t))) + ")"
#: A title's first letter, looked at before all titles are tried.
_FIRST = "(?=[" + "".join(sorted({t[0] for v in TITLES.values() for t in v})) + "])"
_NAME = r"\p{Lu}[\p{L}'-]*\p{Ll}"
#: Type and pattern, in order of precedence where two begin at the same place.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)+"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"),
    # the value given to a password or key, if it has a digit
    ("secret", r"(?<=[=: \"'])(?<=(?i:password|passwd|pwd|secret|token|apikey|api_key|api-key) {0,2}[=:] {0,2}[\"']{0,1})(?=[^\s\"'<>,;()\[\]{}0-9]*+[0-9])[^\s\"'<>,;()\[\]{}]{7,}[0-9A-Za-z_!#$%&*+=@^~|-]"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("ipv4", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{8,15}(?![0-9])"),
    ("number", r"(?<![0-9.])[0-9]{9,19}(?![0-9]|\.[0-9])"),
    ("name", rf"{_FIRST}(?<![\p{{L}}]){_TITLE}\.? {_NAME}(?: {_NAME})?(?![\p{{L}}])"),
]
ANY = "|".join(p for _, p in PATTERNS)
#: Whatever ``ANY`` finds has one of these: a digit, an at sign, a title before a capital, or 32 letters of a hexadecimal number.
LIKELY = rf"[0-9@]|{_FIRST}(?<![\p{{L}}]){_TITLE}\.? \p{{Lu}}|[a-f]{{32}}|[A-F]{{32}}"
#: The digits of a phone number that are replaced; those of the country before them stay.
NATIONAL = 10
#: Draws before a replacement must be taken whatever it equals. Only where a format has hardly more values than the corpus has entities does it come to that.
DRAWS = 24


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def entity_type(e: Column) -> Column:
    """The type of a mention. What no pattern matches whole was found by what is before it: a password, or a name without its title."""
    other = F.when(e.rlike("[0-9]"), F.lit("secret")).otherwise(F.lit("name"))
    return reduce(lambda rest, p: F.when(e.rlike(rf"^(?:{p[1]})\z"), F.lit(p[0])).otherwise(rest), reversed(PATTERNS), other)


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def normal_form(kind: Column, e: Column) -> Column:
    """What all mentions of one entity other than a person share."""
    return (
        F.when(kind == "phone", F.right(_digits(e), F.lit(NATIONAL))).when(kind.isin("card", "ssn", "number"), _digits(e))
        .when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind.isin("email", "secret"), F.lower(e)).otherwise(e)
    )


def untitled(e: Column) -> Column:
    """The names of a mention of a person: given and family name, or one of them."""
    return F.split(F.regexp_replace(e, rf"^{_TITLE}\.? ", ""), " ")


def _titled(e: Column, gender: str) -> Column:
    return e.rlike(rf"^(?:{'|'.join(TITLES[gender])})\.? ")


def known_gender(given: Column) -> Column:
    """The gender of a given name in the lists."""
    names = lambda g: F.array(*[F.lit(n) for s in SYLLABLES for n in GIVEN[s, g]])
    return F.when(F.array_contains(names("m"), given), "m").when(F.array_contains(names("f"), given), "f")


def people(es: Column) -> Column:
    """Of the mentions of one text: (given, gender) of each titled person of two names, as far as the name or title tells."""
    titled = F.filter(es, lambda e: e.rlike(rf"^{_TITLE}\.? ") & (F.size(untitled(e)) > 1))
    told = lambda e: F.coalesce(known_gender(untitled(e)[0]), F.when(_titled(e, "m"), "m").when(_titled(e, "f"), "f"))
    return F.filter(F.transform(titled, lambda e: F.struct(untitled(e)[0].alias("given"), told(e).alias("gender"))), lambda p: p["gender"].isNotNull())


def gender_of(given: Column, known: Column) -> Column:
    """Of a given name, by what the text's titled mentions tell of it."""
    return F.coalesce(known_gender(given), F.get(F.filter(known, lambda p: p["given"] == given), F.lit(0))["gender"], F.lit("n"))


def forms(kind: Column, e: Column, known: Column) -> Column:
    """The normal forms that a mention is made of: one, or of a person the family name and, if it is there, the given name behind its gender."""
    names = untitled(e)
    one = lambda k, f: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), f.alias("form"))
    family = one("family", F.element_at(names, -1))
    given = one("given", F.concat(gender_of(names[0], known), F.lit(":"), names[0]))
    return F.when((kind == "name") & (F.size(names) > 1), F.array(family, given)).when(kind == "name", F.array(family)).otherwise(F.array(one(kind, normal_form(kind, e))))


def _stream(key: Column, n: int) -> Column:
    """``n`` * 32 keyed bytes as hex digits."""
    return F.concat(*[F.sha2(F.concat(key, F.lit(f"\x1f{i}")), 256) for i in range(n)])


def _byte(hexa: Column, i) -> Column:
    return F.conv(F.substr(hexa, F.lit(1) + 4 * (i % 64), F.lit(4)), 16, 10).cast("int")


def _like(e: Column, hexa: Column) -> Column:
    """Every digit and letter replaced by one of the same kind, case and script; the rest stays."""
    near = lambda c, i, first, n: F.pmod(_byte(hexa, i), F.lit(n)) + first
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), char(near(c, i, 48, 10)))
            .when(c.rlike("[a-z]"), char(near(c, i, 97, 26)))
            .when(c.rlike("[A-Z]"), char(near(c, i, 65, 26)))
            .when(c.rlike(r"[а-я]"), char(near(c, i, 0x430, 32)))
            .when(c.rlike(r"[А-Я]"), char(near(c, i, 0x410, 32)))
            .when(c.rlike(r"[α-ω]"), char(near(c, i, 0x3B1, 17)))
            .when(c.rlike(r"\p{Ll}"), char(near(c, i, 97, 26)))
            .when(c.rlike(r"\p{Lu}"), char(near(c, i, 65, 26)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(e, ""), one), "")


def luhn(digits: Column) -> Column:
    """The check digit that the digits before it need."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.pmod(n - i, F.lit(2)) * F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")) + (1 - F.pmod(n - i, F.lit(2))) * c.cast("int"))
    return F.pmod(10 - F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x.cast("int")), F.lit(10)), F.lit(10)).cast("string")


def _card(e: Column, hexa: Column) -> Column:
    """The first digit stays; the last digit is right if it was, and else whatever it is."""
    right = luhn(F.substring(e, 1, 15)) == F.substring(e, 16, 1)
    made = F.concat(F.substring(e, 1, 1), _like(F.substring(e, 2, 14), hexa))
    return F.concat(made, F.when(right, luhn(made)).otherwise(_like(F.substring(e, 16, 1), F.substr(hexa, F.lit(129), F.lit(64)))))


def _ipv4(hexa: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(hexa, i), F.lit(254)) + 1).cast("string")), ".")


def _email(e: Column, hexa: Column) -> Column:
    at = F.instr(e, "@")
    local, domain = F.substr(e, F.lit(1), at - 1), F.substr(e, at + 1)
    top = F.regexp_extract(domain, r"\.[^.]*$", 0)
    return F.concat(_like(local, hexa), F.lit("@"), _like(F.substr(domain, F.lit(1), F.length(domain) - F.length(top)), F.substr(hexa, F.lit(129))), top)


def _phone(e: Column, hexa: Column) -> Column:
    """An exchange 555, which no subscriber has, stays."""
    made = _like(e, hexa)
    return F.when(e.rlike("^[0-9]{3}555[0-9]{4}$"), F.concat(F.substring(made, 1, 3), F.lit("555"), F.substring(made, 7, 4))).otherwise(made)


def _pick(values: list[str], hexa: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(_byte(hexa, F.lit(i)), F.lit(len(values))) + 1)


def _family(e: Column, hexa: Column) -> Column:
    of = lambda script: F.initcap(F.concat(*[_pick(SYLLABLES[script], hexa, i) for i in range(4)]))
    return F.when(e.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


#: Draws of a given name from the lists; later ones are made of syllables, with an ending that tells the gender.
LISTED = 3
ENDINGS = {"m": ("us", "ан"), "f": ("ia", "ия"), "n": ("el", "ей")}


def _given(form: Column, hexa: Column, attempt: Column) -> Column:
    """A given name of the same script and gender, and another than the one replaced."""
    gender, given = F.substring(form, 1, 1), F.substr(form, F.lit(3))

    def of(names: list[str]) -> Column:
        n = _pick(names, hexa, 0)
        return F.when(n == given, F.element_at(F.array(*map(F.lit, names)), F.pmod(_byte(hexa, F.lit(0)) + 1, F.lit(len(names))) + 1)).otherwise(n)

    def by(script: str, nth: int) -> Column:
        end = F.when(gender == "m", ENDINGS["m"][nth]).when(gender == "f", ENDINGS["f"][nth]).otherwise(ENDINGS["n"][nth])
        made = F.initcap(F.concat(*[_pick(SYLLABLES[script], hexa, i) for i in range(3)], end))
        listed = F.when(gender == "m", of(GIVEN[script, "m"])).when(gender == "f", of(GIVEN[script, "f"])).otherwise(of(GIVEN[script, "n"]))
        return F.when(attempt < LISTED, listed).otherwise(made)

    return F.when(given.rlike(r"\p{IsCyrillic}"), by("cyrillic", 1)).otherwise(by("latin", 0))


def draw(kind: Column, form: Column, key: str, attempt: Column) -> Column:
    """The replacement of a normal form at the given attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string"))
    return _bound(
        _stream(seed, 4),
        lambda h: F.when(kind == "email", _email(form, h)).when(kind == "ipv4", _ipv4(h)).when(kind == "card", _card(form, h))
        .when(kind == "phone", _phone(form, h)).when(kind == "family", _family(form, h)).when(kind == "given", _given(form, h, attempt))
        .when((kind == "secret") & form.rlike("^[0-9a-f]+$"), _bound(_stream_as_long(seed, F.length(form)), lambda x: F.substr(x, F.lit(1), F.length(form))))
        .when(kind == "iban", F.concat(F.substring(form, 1, 2), _like(F.substr(form, F.lit(3)), h)))
        .otherwise(_like(form, h)),
    )


def _stream_as_long(seed: Column, n: Column) -> Column:
    """Keyed hex digits, ``n`` or more."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(n / 64).cast("int")), lambda i: F.sha2(F.concat(seed, F.lit("\x1f"), i.cast("string")), 256)), "")


def _filled(e: Column, drawn: Column) -> Column:
    """The mention with its last letters and digits, as many as ``drawn`` has, replaced by those of ``drawn``."""
    bare = lambda c: F.regexp_replace(c, "[^0-9A-Za-z]", "")
    stay = F.length(bare(e)) - F.length(drawn)

    def one(c: Column, i: Column) -> Column:
        nth = F.length(bare(F.substr(e, F.lit(1), i + 1))) - stay
        return F.when(c.rlike("[0-9A-Za-z]") & (nth > 0), F.substr(drawn, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(e, ""), one), "")


def render(kind: Column, e: Column, parts: Column) -> Column:
    """The surrogate, from the replacements of the mention's forms, in its format: title, spacing, punctuation and letter case are the mention's."""
    title, drawn = F.regexp_extract(e, rf"^{_TITLE}\.? ", 0), parts[0]
    given = F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(1)), F.lit(" "))).otherwise("")
    cased = F.array_join(F.zip_with(F.split(drawn, ""), F.split(e, ""), lambda d, c: F.when(c.rlike(r"\p{Lu}"), F.upper(d)).otherwise(d)), "")
    return F.when(kind == "name", F.concat(title, given, drawn)).when(kind.isin("email", "secret"), cased).when(kind == "ipv4", drawn).otherwise(_filled(e, drawn))


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) of the normal forms whose first draw is taken, with one that is not.

    A replacement is taken if it equals any normal form of its kind in the corpus or the replacement of a smaller one.
    """
    first = entities.select("kind", "form", draw(F.col("kind"), F.col("form"), key, F.lit(0)).alias("surrogate"))
    real = entities.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("isreal"))

    def split(drawn: DataFrame, taken: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        nth = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("form"))
        drawn = drawn.withColumn("nth", nth).join(real, ["kind", "surrogate"], "left")
        held = taken.select("kind", "surrogate", F.lit(True).alias("istaken")) if taken is not None else None
        drawn = drawn.join(held, ["kind", "surrogate"], "left") if held is not None else drawn.withColumn("istaken", F.lit(None).cast("boolean"))
        good = (F.col("nth") == 1) & F.col("isreal").isNull() & F.col("istaken").isNull()
        drawn = written(drawn.select("kind", "form", "surrogate", good.alias("good")), "draws")
        return drawn.filter("good").drop("good"), drawn.filter("not good").drop("good")

    taken, again = split(first, None)
    settled = entities.select("kind", "form", F.col("form").alias("surrogate")).limit(0)
    for attempt in range(1, DRAWS + 1):
        if again.isEmpty():
            break
        fine, again = split(again.select("kind", "form", draw(F.col("kind"), F.col("form"), key, F.lit(attempt)).alias("surrogate")), taken)
        taken, settled = taken.unionAll(fine), settled.unionAll(fine)
    return settled.unionAll(again)


#: So many bytes of redrawn entities are broadcast to the texts; beyond it they are joined by row.
BROADCAST_BYTES = 16 << 20


def replace_private(docs: DataFrame, key: str, *, text: str = "text", into: str = "private") -> DataFrame:
    """``docs`` with a struct column ``into``: text (with surrogates), entities, kinds and surrogates, in order of mention.

    Null texts give a null text and no entities; texts without entities stay as they are. The same entity has the same
    surrogate wherever and in whatever format it is mentioned, two entities do not share one, and none is an entity of the corpus; only where
    a format has hardly more values than the corpus has entities of it may the last of ``DRAWS`` draws be taken twice.
    Two persons with one family name share its surrogate, and those with one given name, of one gender, share that; so persons of two names are told apart. A
    given name's replacement may be somebody's given name elsewhere. A name is found behind a title, and then wherever else it is in the same text, whole or
    the family name alone. All columns of ``docs`` stay but one called ``into``.
    """
    none = F.array().cast("array<string>")
    each = docs.withColumn("__first", F.when(F.col(text).rlike(LIKELY), F.regexp_extract_all(F.col(text), F.lit(ANY), 0)))
    # names without their titles: longest first, so that a family name does not cut a whole one short
    titled = F.filter("__first", lambda e: e.rlike(rf"^{_TITLE}\.? {_NAME}"))
    bare = F.flatten(F.transform(titled, lambda e: F.array(F.array_join(untitled(e), " "), F.element_at(untitled(e), -1))))
    bare = F.array_sort(F.array_distinct(bare), lambda a, b: F.length(b) - F.length(a))
    more = F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), F.array_join(bare, "|"), F.lit(r")(?![\p{L}])"))
    each = each.withColumn("__any", F.when(F.size(titled) > 0, more).when(F.size("__first") > 0, F.lit(ANY)))
    each = each.withColumn("__es", F.when(F.size(titled) > 0, F.regexp_extract_all(F.col(text), F.col("__any"), F.lit(0))).otherwise(F.coalesce("__first", none)))
    each = each.withColumn("__ks", F.transform("__es", entity_type)).withColumn("__people", people(F.col("__es")))
    each = each.withColumn("__fs", F.zip_with("__ks", "__es", lambda k, e: forms(k, e, F.col("__people"))))

    # a row of each text with entities: equal texts have equal ones
    row = F.sha2(F.col(text), 256)
    mentions = each.filter(F.size("__es") > 0).select(row.alias("__row"), F.explode(F.array_distinct(F.flatten("__fs"))).alias("f")).select("__row", "f.kind", "f.form").distinct()
    mentions = written(mentions, "mentions")
    fixes = written(collisions(mentions.select("kind", "form").distinct(), key), "fixes")
    fixed = F.lit(None).cast("map<struct<kind:string,form:string>,string>")
    if not fixes.isEmpty():
        maps = mentions.join(fixes, ["kind", "form"]).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "form"), "surrogate"))).alias("__fix"))
        maps = written(maps, "maps")
        size = maps.agg(F.sum(F.lit(100) + F.aggregate(F.map_entries("__fix"), F.lit(0), lambda a, x: a + 40 + F.length(x["key"]["form"]) + F.length(x["value"])))).first()[0]
        each = each.withColumn("__row", F.when(F.size("__es") > 0, row))
        each = each.join(F.broadcast(maps) if size <= BROADCAST_BYTES else maps, "__row", "left").drop("__row")
        fixed = F.col("__fix")
    else:
        each = each.withColumn("__fix", F.lit(None))
    drawn = F.transform("__fs", lambda fs: F.transform(fs, lambda f: F.coalesce(F.element_at(fixed, f), draw(f["kind"], f["form"], key, F.lit(0)))))
    each = each.withColumn("__ds", drawn)
    made = F.transform(F.arrays_zip("__ks", "__es", "__ds"), lambda m: render(m["__ks"], m["__es"], m["__ds"]))
    each = each.withColumn("__ss", made)
    pieces = F.split(F.col(text), F.col("__any"), -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.col("__ss"), lambda p, s: F.array(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))), "")
    out = F.struct(
        F.when(F.size("__es") == 0, F.col(text)).otherwise(joined).alias("text"), F.col("__es").alias("entities"), F.col("__ks").alias("kinds"), F.col("__ss").alias("surrogates")
    )
    return each.withColumn(into, out).drop("__first", "__any", "__es", "__ks", "__fs", "__ds", "__people", "__ss", "__fix")
