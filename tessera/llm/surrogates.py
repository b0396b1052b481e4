"""Personal data replaced by surrogates, with DataFrame functions alone.

One pattern finds entities: e-mail and IP addresses, telephone, card, social-security and IBAN numbers, secrets and names
after a title. Each gets a surrogate of its own kind, derived from a secret key and the entity's normal form,
so one entity has one surrogate everywhere (coreference) while separators, case, script, gender of names, number of
digits, issuer digit and Luhn validity of cards stay as they were. Long numbers that no issuer's range or check digit marks as cards stay.

Collision check: for each kind, every entity of the corpus proposes a surrogate. It belongs to its first claimant
and never to a value that occurs in the corpus; those left propose again, round by round, until none is left. So distinct
entities have distinct surrogates. Names grow by syllables from round to round, and secrets by characters, so they don't run out. Kinds whose form
bounds their number (IPv4 addresses, short numbers) can run out: that raises an error. Only entities whose first proposal is not theirs (a few) are looked up, by the key of
the rows that hold them; the lookup is written first, so Spark broadcasts it only if its size allows.

Defined results: null text stays null, text without entities is unchanged; equal texts get equal results whatever their key;
rows that repeat a key, and null keys, are handled; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import discard, free_name, materialise

#: Rounds after which a kind of bounded form counts as run out; each settles most of what is left, so few are needed.
ROUNDS = 200
#: Rounds in which surrogates may not be values of the corpus.
STRICT = 100

# Titles by gender, the stems and endings that make names, alphabets.
_MALE = "Mr|Herr|Monsieur|Señor|господин|г-н|Sr"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|госпожа|г-жа|Sra"
_NEUTRAL = "Dr|Prof|Dra"
_STEMS = {"latin": "Al Bar Cor Dar El Fal Gar Hal Jar Kal Lor Mar Nor Or Per Rol Sal Tar Ul Val War Yor Zan Bel".split(),
          "cyrillic": "Ал Бор Вар Гор Дан Ел Жар Зор Ив Кар Лар Мар Нал Ор Пар Рол Сав Тар Ур Фад Хар Цал Яр Бел".split()}
_GIVEN = {("latin", "m"): "an ert ik on us ald win ric".split(), ("latin", "f"): "a ina elle ia issa ena ora ette".split(),
          ("cyrillic", "m"): "ан ий слав ент ил ислав ей мир".split(), ("cyrillic", "f"): "а ина ия ена ора ана елла ика".split()}
_MIDDLE = {"latin": "b d f g l m n p r s t v br dr st nd".split(), "cyrillic": "б в г д л м н п р с т ф бр др ст нд".split()}
_FAMILY = {"latin": "ington ner sen er man well ford ton ley field wick mont berg hart ham by".split(),
           "cyrillic": "енко ук ич ян ко ский ов ев ин ых як ец юк ай ба ль".split()}
_LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TITLE = (r"(?:(?:Mr|Mrs|Ms|Dr|Dra|Prof|Mme|Mlle|Sr|Sra)\.|Mrs|Mr|Miss|Herr|Frau|Monsieur|Madame|Mademoiselle|Señora|Señorita|Señor|"
          r"господин|госпожа|г-н|г-жа)")
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}",
    "key": r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,]++|-(?!----))*+-----END [A-Z ]{0,24}PRIVATE KEY-----",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/=.-]{8})(?:(?<=(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)"
              r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?:[A-Za-z0-9_+/=-]++|\.(?=[A-Za-z0-9_+/=-]))++|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+"
              r"|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|[0-9a-f]{32,}+(?![A-Za-z0-9_])(?<=[0-9][0-9a-f]{0,31})"
              r"|[0-9A-F]{32,}+(?![A-Za-z0-9_])(?<=[0-9][0-9A-F]{0,31}))",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,8}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
            r"|(?:[0-9A-Fa-f]{1,4}:){2,7}:))(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "phone": r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"
             r"|(?<![\w+])\+[0-9](?:[ ().-]{0,2}[0-9]){7,14}(?!\w)",
    "name": rf"(?<!\p{{L}}){_TITLE}\s\p{{Lu}}[\p{{L}}'’-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'’-]{{1,40}}){{0,2}}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these hold no entity: a cheap test, as most positions fail on one character.
_HINT = rf"[0-9@=:]|-----BEGIN|AKIA|sk-|gh[pousr]_|xox|eyJ|(?=[DFHMPSг])(?<!\p{{L}}){_TITLE}\s\p{{Lu}}"


def _is_card(digits: Column) -> Column:
    """Whether digits are a card's: a known issuer range and a valid check digit."""
    return digits.rlike("^(?:4|5[0-9]|2[2-7]|3[0-9]|6[0-9])") & (_luhn(digits) == 0)


def _kind(x: Column) -> Column:
    """Kind of a found entity, by its form; ``number`` is a long number that is no card's, and not personal."""
    return (
        F.when(x.contains("@"), "email").when(x.startswith("-----"), "key")
        .when(x.rlike(rf"^{_TITLE}\s\p{{Lu}}"), "name")
        .when(x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ipv4").when(x.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(x.rlike("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .when(x.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), F.when(_is_card(F.regexp_replace(x, "[^0-9]", "")), "card").otherwise("number")).when(x.rlike(r"^[+(]?[0-9][0-9 ().+-]*$"), "phone").otherwise("secret")
    )


def _normal(x: Column, kind: Column) -> Column:
    """Form by which entities are the same."""
    return (
        F.when(kind == "email", F.lower(x)).when(kind.isin("card", "ssn", "phone"), F.regexp_replace(x, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(x, " ", "")).when(kind == "ipv6", F.lower(x))
        .when(kind == "name", F.lower(F.regexp_replace(x, rf"^{_TITLE}\s", ""))).otherwise(x)
    )


def _draw(seed: Column, i: Column | int) -> Column:
    """A number from 0 to 255 from the keyed digest; positions repeat after 64."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(seed, ((i - 1) % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def _each(x: Column, change) -> Column:
    """``change(character, position)`` over the characters of a text."""
    return F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c, i: change(c, i + 1)), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _same_class(x: Column, seed: Column, start: int = 0) -> Column:
    """Each digit and letter replaced by one of its class and script, from position ``start`` + 1 on."""

    def change(c, i):
        n = _draw(seed, i)
        out = (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), _letter(_LOWER["latin"], n))
            .when(c.rlike("[A-Z]"), F.upper(_letter(_LOWER["latin"], n))).when(c.rlike(r"\p{IsCyrillic}") & (c == F.lower(c)), _letter(_LOWER["cyrillic"], n))
            .when(c.rlike(r"\p{IsCyrillic}"), F.upper(_letter(_LOWER["cyrillic"], n)))
            .when(c.rlike(r"\p{Lu}"), F.upper(_letter(_LOWER["latin"], n))).when(c.rlike(r"\p{L}"), _letter(_LOWER["latin"], n)).otherwise(c)
        )
        return F.when(i <= start, c).otherwise(out) if start else out

    return _each(x, change)


def _hex(x: Column, seed: Column) -> Column:
    def change(c, i):
        n = _letter("0123456789abcdef", _draw(seed, i))
        return F.when(c.rlike("[0-9a-f]"), n).when(c.rlike("[A-F]"), F.upper(n)).otherwise(c)

    return _each(x, change)


def _luhn(digits: Column) -> Column:
    """Sum of a digit string modulo 10, the last digit counted once."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10


def _card(x: Column, seed: Column) -> Column:
    """Issuer digit and separators are kept, and the check digit is valid."""

    def renewed(digits):
        middle = F.substring(digits, F.lit(2), F.char_length(digits) - 2)
        return _let(F.concat(F.substring(digits, F.lit(1), F.lit(1)), _each(middle, lambda c, i: (_draw(seed, i) % 10).cast("string"))), lambda body: closed(digits, body))

    def closed(digits, body):
        return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))

    # The n-th digit of the number goes where its n-th digit stood.
    rank = lambda i: F.char_length(F.regexp_replace(F.substring(x, F.lit(1), i.cast("int")), "[^0-9]", ""))
    fresh = _let(F.regexp_replace(x, "[^0-9]", ""), renewed)
    return _let(fresh, lambda f: _each(x, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(f, rank(i), F.lit(1))).otherwise(c)))


def _digits(x: Column, seed: Column, keep: Column) -> Column:
    """Digits replaced by their rank among the digits (so formats agree), but for the first ``keep``."""
    rank = lambda i: F.char_length(F.regexp_replace(F.substring(x, F.lit(1), i.cast("int")), "[^0-9]", ""))
    return _each(x, lambda c, i: F.when(c.rlike("[0-9]") & (rank(i) > keep), (_draw(seed, rank(i)) % 10).cast("string")).otherwise(c))


def _syllables(script: str, seed: Column, attempt: Column) -> Column:
    def one(k):
        return F.concat(F.lower(_pick(_STEMS[script], _draw(seed, 2 * k + 20))), _pick(_MIDDLE[script], _draw(seed, 2 * k + 21)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(attempt / 2).cast("int"))), one), "")


def _name(x: Column, seed: Column, attempt: Column, key: str) -> Column:
    """Title kept; given names by gender and script, the last word a family name that depends on that word alone.

    From the second attempt on, the first word gets a further syllable for each two attempts, so names don't run out.
    """
    title = F.regexp_extract(x, rf"^({_TITLE}\s)", 1)
    words = F.split(F.regexp_replace(x, rf"^{_TITLE}\s", ""), " ")
    n = F.size(words)

    def one(w, i):
        own = F.sha2(F.concat(F.lit(f"{key}|family|"), F.lower(w)), 256)
        by_script = {}
        for script in ("latin", "cyrillic"):
            family_seed = F.when((n > 1) | (attempt == 0), own).otherwise(seed)
            family = F.concat(_pick(_STEMS[script], _draw(family_seed, 1)), _pick(_MIDDLE[script], _draw(family_seed, 2)), _pick(_FAMILY[script], _draw(family_seed, 3)))
            given = {g: F.concat(_pick(_STEMS[script], _draw(seed, i * 2 + 4)), _pick(_GIVEN[script, g], _draw(seed, i * 2 + 5))) for g in "mf"}
            female = title.rlike(rf"^(?:{_FEMALE})\b") | (~title.rlike(rf"^(?:{_MALE})\b") & w.rlike("[aая]$"))
            whole = F.when(i == n - 1, family).when(female, given["f"]).otherwise(given["m"])
            more = _syllables(script, seed, attempt)
            by_script[script] = F.when((i == 0) & (attempt > 0), F.concat(F.initcap(more), F.lower(whole))).otherwise(whole)
        return F.when(w.rlike(r"\p{IsCyrillic}"), by_script["cyrillic"]).otherwise(by_script["latin"])

    return F.concat(title, F.array_join(F.transform(words, one), " "))


def _seed(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """Keyed digits that a surrogate is drawn from."""
    root = F.concat_ws("|", F.lit(key), kind, normal, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(root, F.lit("|0")), 256), F.sha2(F.concat(root, F.lit("|1")), 256))


def _surrogate(x: Column, kind: Column, seed: Column, attempt: Column, key: str) -> Column:
    local, host = F.split_part(x, F.lit("@"), F.lit(1)), F.split_part(x, F.lit("@"), F.lit(2))
    top = _pick(["com", "net", "org"], _draw(seed, 60))
    domain = F.concat(*(_letter(_LOWER["latin"], _draw(seed, 50 + i)) for i in range(7)), F.lit(".example."), top)
    prefix = F.regexp_extract(x, "^(?:AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|)", 0)  # tells the kind of a secret
    country = F.char_length(F.regexp_replace(F.regexp_extract(x, r"^(\+[0-9]{1,3})[ .(-]", 1), "[^0-9]", ""))
    return (
        F.when(kind == "email", F.concat(_same_class(local, seed), F.lit("@"), F.when((host == F.upper(host)) & host.rlike("[A-Z]"), F.upper(domain)).otherwise(domain)))
        .when(kind == "ipv4", F.concat_ws(".", F.when(attempt < 2, F.lit("10")).otherwise((_draw(seed, 4) % 223 + 1).cast("string")),
                                          *(_draw(seed, i).cast("string") for i in (1, 2, 3))))
        .when(kind == "ipv6", F.when(attempt < 2, _hex(x, seed)).otherwise(F.concat_ws(":", *(F.substring(seed, 4 * i + 1, 4) for i in range(8)))))
        .when(kind == "ssn", F.concat(F.when(attempt < 2, F.lit("9")).otherwise((_draw(seed, 12) % 10).cast("string")), F.substring(_digits(x, seed, F.lit(1)), 2, 10)))
        .when(kind == "iban", _same_class(x, seed, 2)).when(kind == "card", _card(x, seed)).when(kind == "phone", _digits(x, seed, country))
        .when(kind == "name", _name(x, seed, attempt, key))
        .when(kind == "key", F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), seed, F.lit("\n-----END PRIVATE KEY-----")))
        .when(kind == "number", x)
        .when(x.rlike("^[0-9a-f]+$"), _hex(x, seed)).when(x.rlike("^[0-9A-F]+$"), F.upper(_hex(x, seed)))
        .otherwise(F.concat(prefix, _same_class(F.substring(x, F.char_length(prefix) + 1, F.char_length(x)), seed), F.when(attempt >= 4, F.substring(seed, 101, 16)).otherwise("")))
    )


def _entities(text: Column) -> Column:
    """Entities of a text in order, as structs of the entity, its kind and its normal form; null without any.

    Each step binds what it computes to a lambda's variable, so nothing is computed twice.
    """
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    kinds = F.transform(found, lambda x: F.struct(x.alias("x"), _kind(x).alias("kind")))
    return F.transform(kinds, lambda e: F.struct(e["x"].alias("x"), e["kind"].alias("kind"), _normal(e["x"], e["kind"]).alias("normal")))


def _proposals(rows: DataFrame, key: str) -> DataFrame:
    """``kind, normal, attempt`` of ``rows`` with ``s``, the normal form of what they propose."""
    rows = rows.withColumn("seed", _seed(F.col("kind"), F.col("normal"), F.col("attempt"), key))
    rows = rows.withColumn("s", _surrogate(F.col("x"), F.col("kind"), F.col("seed"), F.col("attempt"), key))
    return rows.select("kind", "normal", "attempt", _normal(F.col("s"), F.col("kind")).alias("s"))


def _owners(claims: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """First claimant of each proposal that no one has: ``kind, s, normal, attempt``."""
    first = claims.groupBy("kind", "s").agg(F.min(F.struct("attempt", "normal")).alias("o"))
    for t in taken:
        first = first.join(t, ["kind", "s"], "left_anti")
    return first.select("kind", "s", "o.normal", "o.attempt")


def _exceptions(found: DataFrame, key: str, write=materialise) -> DataFrame:
    """``kind, normal, attempt`` of entities whose first proposal is another's, or a value of the corpus. ``write`` stores what is read again."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = found.groupBy("kind", "normal").agg(F.min("x").alias("x")).repartition(parts, "kind", "normal")
    known = write(known, "entities").repartition(parts, "kind", "normal")
    values = known.select("kind", F.col("normal").alias("s"))
    first = write(_owners(_proposals(known.withColumn("attempt", F.lit(0)), key), [values]), "first-proposals")
    lost = known.join(first.select("kind", "normal"), ["kind", "normal"], "left_anti")
    lost = write(lost, "lost")  # few: those whose first proposal was taken
    taken, moved = [values, first.select("kind", "s")], lost.select("kind", "normal", F.lit(0).alias("attempt")).where("false")
    for attempt in range(1, ROUNDS):
        if lost.isEmpty():
            return moved
        if attempt == STRICT:
            taken = taken[1:]
        won = write(_owners(_proposals(lost.withColumn("attempt", F.lit(attempt)), key), taken), "later-proposals")
        taken.append(won.select("kind", "s"))
        moved = moved.union(won.select("kind", "normal", "attempt"))
        lost = write(lost.join(won.select("kind", "normal"), ["kind", "normal"], "left_anti"), "lost")
    if lost.isEmpty():
        return moved
    raise ValueError(f"no surrogate is left for {lost.count()} entities of kinds {[r.kind for r in lost.select('kind').distinct().collect()]}")


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text_col`` replaced; ``key`` is the secret that surrogates depend on.

    ``count_col`` adds the number of entities found.
    """
    text = F.col(f"`{text_col}`")
    found = docs.select(F.xxhash64(text).alias("h"), F.explode(_entities(text)).alias("e")).select("h", "e.*").where("kind <> 'number'")
    made: list[DataFrame] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    found = write(found, "found")  # a small part of the texts; found once
    moved = _exceptions(found, key, write)
    lookup = found.select("h", "kind", "normal").distinct().join(moved, ["kind", "normal"])
    name = F.concat_ws("|", "kind", "normal")
    by, at = free_name(docs, "moved"), free_name(docs, "moved_in")
    lookup = lookup.groupBy(F.col("h").alias(at)).agg(F.map_from_entries(F.collect_set(F.struct(name.alias("k"), "attempt"))).alias(by))
    lookup = materialise(lookup, "moved")
    discard(*made)

    rows = docs.join(lookup, F.xxhash64(text) == F.col(at), "left")
    entities = free_name(docs, "entities")
    rows = rows.withColumn(entities, _entities(text))

    def seeded(e):
        attempt = F.coalesce(F.try_element_at(F.col(by), F.concat_ws("|", e["kind"], e["normal"])), F.lit(0))
        return F.struct(e["x"].alias("x"), e["kind"].alias("kind"), attempt.alias("attempt"), _seed(e["kind"], e["normal"], attempt, key).alias("seed"))

    fresh = F.transform(F.transform(F.col(entities), seeded), lambda e: _surrogate(e["x"], e["kind"], e["seed"], e["attempt"], key))
    gaps = F.split(text, _ANY, -1)
    whole = F.array_join(F.zip_with(gaps, fresh, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    names = [c for c in docs.columns if not count_col or c.lower() != count_col.lower()]
    out = [F.when(F.size(entities) > 0, whole).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    if count_col:
        out.append(F.coalesce(F.array_size(F.filter(entities, lambda e: e["kind"] != "number")), F.lit(0)).cast("long").alias(count_col))
    return rows.select(*out)
