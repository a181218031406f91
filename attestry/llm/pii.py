"""Personal data replaced by surrogates.

Detected entities receive a keyed replacement of the same type and format. The same entity gets the same surrogate
everywhere, so coreference stays; different entities get different ones:

* phone, card, bank account (IBAN) and social security numbers and IPv4 addresses go through a Feistel network over their
  own digits (over 32 bits for addresses). That is a bijection, so two entities can't meet. Separators, country code
  and whether the check digits of a card or account are valid stay.
* e-mail addresses, person names, IPv6 addresses and secrets get text made from a keyed hash.

:func:`find_plan` checks the surrogates of all entities of the table. It widens the hash until no two entities share a surrogate
and none equals a real entity, and tries up to ``ROUNDS`` bijections for one that gives no real number either; where a
table holds so many numbers that none does, it takes one that leaves no number as it is.

Names are found by a title, a common given name or a patronymic with capitalised words after (before) it, or by what introduces
them ("my name is"). Title, given name or patronymic picks the gender, the script picks the alphabet. Other names are left.
Phone numbers are found with a plus and country code, with an area code in parentheses, or as 555-123-4567 or 555.123.4567, the
latter forms also after a leading 1. A number is the same entity however it is written, with or without the code 1.
Other national ways of writing them are left, as they look like any other numbers.
A quick pattern, of which every entity has a part, spares texts without any the whole one.

There is no default key: whoever has it can undo the bijections. :func:`key_of` takes it from the session's setting
``KEY_SETTING`` and, where that is unset, draws a new one for the application.

Edge cases: a null text stays null, with no entities; an empty table gives no rows; repeated rows are replaced
alike; very long texts are one row like others. Columns of the input called n_entities are replaced; others stay.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

KEY_SETTING = "spark.surrogates.key"
WIDTH, MOST, ROUNDS = 12, 48, 8
MALE_TITLES = "Mr|Sir|Herr|Monsieur|Señor|Don|г-н|[Гг]осподин"
FEMALE_TITLES = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Señorita|Doña|г-жа|[Гг]оспожа"
OTHER_TITLES = "Dr|Prof|[Дд]октор|[Пп]рофессор|[Пп]роф|д-р"
#: Common given names that are hardly ever another word.
MALE_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Daniel|Matthew|Anthony|Steven|Andrew|Kevin|Brian|George|Edward|Peter|Paul|"
    "Hans|Klaus|Jürgen|Wolfgang|Dieter|Stefan|Andreas|Günter|Jean|Pierre|Jacques|Michel|François|Philippe|Alain|Nicolas|Juan|José|Carlos|Luis|Antonio|Miguel|Javier|Pedro|Fernando|"
    "Иван|Александр|Сергей|Дмитрий|Андрей|Алексей|Михаил|Николай|Владимир|Пётр|Борис|Виктор"
)
FEMALE_NAMES = (
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Margaret|Emily|Laura|Julia|Anna|Emma|Maria|Helen|Rachel|"
    "Ursula|Monika|Petra|Sabine|Renate|Brigitte|Claudia|Katharina|Marie|Jeanne|Françoise|Isabelle|Nathalie|Sylvie|Catherine|Sophie|Carmen|Isabel|Lucía|Pilar|Dolores|Teresa|"
    "Елена|Ольга|Наталья|Татьяна|Ирина|Анна|Мария|Светлана|Екатерина|Вера|Дарья"
)
INTRODUCTIONS = "[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут"
_LABEL = r"[\p{L}\p{N}\-]"
#: Up to the letters of the last label that starts with two; what repeats is possessive, as else each label takes a stack frame.
_TOP = rf"(?:\.(?!\p{{L}}{{2}}){_LABEL}++)*+\.\p{{L}}{{2,}}+"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+\-])[\p{{L}}\p{{N}}._%+\-]++@{_LABEL}++{_TOP}(?:{_LABEL}*+{_TOP})*+"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?=(?:[A-Z ]*\d){8})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
NATIONAL = r"(?<![\p{L}\p{N}.\-])(?:1[ .\-])?(?:\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}|\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4})(?![.\-]?\d)"
PHONE = r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\d)"
IPV6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\p{L}\p{N}])"
_CAPITAL = r"\p{Lu}[\p{L}\p{M}'’\-]+"
_CYRILLIC = r"\p{Lu}\p{IsCyrillic}+"
PATRONYMIC = r"\p{Lu}\p{IsCyrillic}+(?:вич|вна|ична)"
TITLE = rf"(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})(?:(?<!г-н|г-жа)\.)? "
#: The first letter is asked first: what follows is costly and most places fail it.
NAME = (
    rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{Lu}}гдп])(?:{TITLE}{_CAPITAL}(?: {_CAPITAL}){{0,2}}|(?:{MALE_NAMES}|{FEMALE_NAMES})(?![\p{{L}}\p{{M}}'’\-])(?: {_CAPITAL}){{1,2}}"
    rf"|(?:{_CYRILLIC} ){{1,2}}{PATRONYMIC}(?!\p{{L}})(?: {_CYRILLIC})?|(?<=(?:{INTRODUCTIONS}) ){_CAPITAL}(?: {_CAPITAL}){{0,2}})"
)
ENTITY = "|".join((EMAIL, SECRET, IBAN, PHONE, NATIONAL, IPV6, IP, SSN, CARD, NAME))
#: Every entity has a digit or an at sign, or is a key of letters or a name.
HINT = rf"[0-9@]|AKIA|gh[pousr]_|sk-|[a-f]{{32}}|[A-F]{{32}}|{NAME}"
#: Country codes as E.164 deals them, at the start of a number's digits.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
DIGITS = ("phone", "ip", "ssn", "card", "iban")
GIVEN = {
    ("f", "latin"): ("Ada", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Ida", "Julia", "Karla", "Lena", "Maria", "Nora", "Olga", "Petra"),
    ("m", "latin"): ("Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Kurt", "Leo", "Martin", "Noah", "Oskar", "Paul"),
    ("o", "latin"): ("Alex", "Ari", "Charlie", "Dana", "Eden", "Finn", "Gale", "Harper", "Jamie", "Kim", "Luca", "Morgan", "Noa", "Quinn", "Robin", "Sasha"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"),
    ("o", "cyrillic"): ("Саша", "Женя", "Валя", "Слава", "Паша", "Вася", "Шура", "Люба"),
}
FATHERS = {"m": ("Иванович", "Петрович", "Львович", "Олегович"), "f": ("Ивановна", "Петровна", "Львовна", "Олеговна")}
SYLLABLES = {
    "latin": tuple(a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o"))[:32],
    "cyrillic": tuple(a + b for a in "бвгдклмн" for b in "аеио"),
}


@dataclass(frozen=True)
class Plan:
    """How wide hashed surrogates are, and which bijection numbers go through."""

    width: int = WIDTH
    round: int = 0


_drawn: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The session's key, or one drawn for this application."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _digest(key: str, what: Column, salt: Column | str) -> Column:
    """64 keyed hexadecimal digits."""
    return F.sha2(F.concat(F.lit(key + "|"), salt if isinstance(salt, Column) else F.lit(salt), F.lit("|"), what), 256)


def _number(hexa: Column) -> Column:
    return F.conv(F.substr(hexa, F.lit(1), F.lit(14)), 16, 10).cast("long")


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A keyed bijection on the digit strings of each length from 2 to 34."""

    def body(d):
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        b = n - a
        pair = F.struct(F.substr(d, F.lit(1), a).cast("long").alias("l"), F.substr(d, a + 1, b).cast("long").alias("r"))
        # a step's name is bound outside the lambda: a second argument of that would be taken for the place in the array
        add = lambda x, by, step, most: F.pmod(x + F.pmod(_number(_digest(key, F.concat(n.cast("string"), F.lit(":"), by.cast("string")), step)), most), most)
        left = lambda step: lambda p: F.struct(add(p["l"], p["r"], step, _pow10(a)).alias("l"), p["r"].alias("r"))
        right = lambda step: lambda p: F.struct(p["l"].alias("l"), add(p["r"], p["l"], step, _pow10(b)).alias("r"))
        for r in range(3):
            pair = _let(_let(pair, left(f"{tag}{r}l")), right(f"{tag}{r}r"))
        return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), a, F.lit("0")), F.lpad(p["r"].cast("string"), b, F.lit("0"))))

    return _let(digits, body)


def luhn_digit(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    n = F.length(digits)
    one = lambda i: _let(F.substr(digits, n - i + 1, F.lit(1)).cast("int"), lambda v: F.when(i % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, v: a + v)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def fill_digits(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by these."""
    at = lambda i: F.length(_digits(F.substr(shape, F.lit(1), i)))
    char = lambda i: F.substr(shape, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(char(i).between("0", "9"), F.substr(digits, at(i), F.lit(1))).otherwise(char(i))), "")


def _code(x: Column) -> Column:
    """The country code's digits: of a number with a plus, or a leading 1."""
    return F.when(F.startswith(x, F.lit("+")), F.regexp_extract(_digits(x), COUNTRY, 0)).otherwise(F.regexp_extract(x, r"^(1)[ .\-]", 1))


def _phone(x: Column, key: str) -> Column:
    d = F.struct(_digits(x).alias("d"), _code(x).alias("c"))
    return _let(d, lambda p: fill_digits(x, F.concat(p["c"], permute_digits(F.substr(p["d"], F.length(p["c"]) + 1, F.length(p["d"])), key, "phone"))))


def check_digits(country: Column, rest: Column) -> Column:
    """What the two check digits of an account number must be, 2 to 98."""
    chars = F.split(F.concat(rest, country, F.lit("00")), "")
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return 98 - F.aggregate(chars, F.lit(0), step)


def _iban(x: Column, key: str) -> Column:
    country, rest = F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(5), F.length(x))
    bare = lambda r: F.replace(r, F.lit(" "), F.lit(""))
    off = F.substr(x, F.lit(3), F.lit(2)).cast("int") - check_digits(country, bare(rest))

    def body(r):
        check = F.pmod(check_digits(country, bare(r)) + off - 2, F.lit(97)) + 2
        return F.concat(country, F.lpad(check.cast("string"), 2, F.lit("0")), r)

    return _let(fill_digits(rest, permute_digits(_digits(rest), key, "iban")), body)


def _ipv6(x: Column, key: str) -> Column:
    h = _digest(key, F.lower(x), "ipv6")
    return F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.substr(h, F.lit(1 + 4 * i), F.lit(4))) for i in range(6)))


def _card(x: Column, key: str) -> Column:
    def body(d):
        head = F.substr(d, F.lit(1), F.length(d) - 1)
        off = F.pmod(F.right(d, F.lit(1)).cast("int") - luhn_digit(head), F.lit(10))
        return _let(permute_digits(head, key, "card"), lambda h: F.concat(h, F.pmod(luhn_digit(h) + off, F.lit(10)).cast("string")))

    return fill_digits(x, _let(_digits(x), body))


def _ip(x: Column, key: str) -> Column:
    def body(o):
        q = lambda i: F.get(o, i).cast("long")
        pair = F.struct((q(0) * 256 + q(1)).alias("l"), (q(2) * 256 + q(3)).alias("r"))
        m = F.lit(65536)
        left = lambda step: lambda p: F.struct(F.pmod(p["l"] + _number(_digest(key, p["r"].cast("string"), step)), m).alias("l"), p["r"].alias("r"))
        right = lambda step: lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + _number(_digest(key, p["l"].cast("string"), step)), m).alias("r"))
        for r in range(3):
            pair = _let(_let(pair, left(f"ip{r}l")), right(f"ip{r}r"))
        return _let(pair, lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("long"), p["l"] % 256, F.floor(p["r"] / 256).cast("long"), p["r"] % 256))

    return _let(F.split(x, r"\."), body)


def _pick(hexa: Column, at: int, values: tuple[str, ...]) -> Column:
    # one literal, split when the plan is made
    return F.get(F.split(F.lit("|".join(values)), r"\|"), F.pmod(F.conv(F.substr(hexa, F.lit(at), F.lit(6)), 16, 10).cast("long"), F.lit(len(values))).cast("int"))


def _email(x: Column, key: str, width: int) -> Column:
    h = _digest(key, F.lower(x), "email")
    given = _pick(h, 1, tuple(n.lower() for n in GIVEN["o", "latin"]))
    made = F.concat(given, F.lit("."), F.substr(h, F.lit(8), F.lit(width)), F.lit("@mail"), _pick(h, 58, tuple("0123456789")), F.lit(".example.org"))
    return F.when((F.upper(x) == x) & F.rlike(x, F.lit(r"\p{L}")), F.upper(made)).otherwise(made)


def _secret(x: Column, key: str) -> Column:
    h = F.concat(_digest(key, x, "secret0"), _digest(key, x, "secret1"))
    prefix = F.regexp_extract(x, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    made = F.concat(prefix, F.substr(h, F.lit(1), F.length(x) - F.length(prefix)))
    return F.when(F.rlike(x, F.lit("[a-z]")), made).otherwise(F.concat(prefix, F.upper(F.substr(made, F.length(prefix) + 1, F.length(x)))))


def _bare(x: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(x, rf"^{TITLE}", "")


def _family(words: Column) -> Column:
    """The family name among a name's words: the last; the first where a patronymic ends three, none where it ends two."""
    last = F.element_at(words, -1)
    return F.when(~F.rlike(last, F.lit(rf"^{PATRONYMIC}$")), last).when(F.size(words) > 2, F.get(words, F.lit(0)))


def _name(x: Column, key: str, width: int) -> Column:
    """The title stays. The family name follows from that word alone, so that a later short form agrees; what comes
    with it gives a name of the right gender, with a made-up middle name where the width asks for one."""
    bare = _bare(x)
    title = F.substr(x, F.lit(1), F.length(x) - F.length(bare))
    words = F.split(bare, " ")
    family = _family(words)
    g = _digest(key, bare, "given")
    has = lambda p: F.rlike(bare, F.lit(rf"(?<!\p{{L}}){p}(?!\p{{L}})"))
    titled = lambda t: F.rlike(title, F.lit(rf"^(?:{t})\.? "))
    gender = F.when(titled(FEMALE_TITLES), "f").when(titled(MALE_TITLES), "m")
    gender = gender.when(has(rf"(?:{FEMALE_NAMES})") | has(r"\p{IsCyrillic}+(?:вна|ична)"), "f").when(has(rf"(?:{MALE_NAMES})") | has(r"\p{IsCyrillic}+вич"), "m").otherwise("o")
    father = F.rlike(bare, F.lit(rf"(?<!\p{{L}}){PATRONYMIC}(?!\p{{L}})"))
    made = None
    for script in ("latin", "cyrillic"):
        word = lambda h, n, script=script: F.initcap(F.concat(*(_pick(h, 8 + 3 * i, SYLLABLES[script]) for i in range(n))))
        given = _pick(g, 1, GIVEN["o", script])
        for k in ("m", "f"):
            given = F.when(gender == k, _pick(g, 1, GIVEN[k, script])).otherwise(given)
        if width > WIDTH:
            given = F.concat(given, F.lit(" "), word(g, width // 6))
        if script == "cyrillic":
            given = F.when(father, F.concat(given, F.lit(" "), F.when(gender == "f", _pick(g, 20, FATHERS["f"])).otherwise(_pick(g, 20, FATHERS["m"])))).otherwise(given)
        new = word(_digest(key, family, "family"), max(4, width // 3))
        whole = F.when(family.isNull(), given).when(F.size(words) > 1, F.concat(given, F.lit(" "), new)).otherwise(new)
        made = whole if made is None else F.when(F.rlike(bare, F.lit(r"\p{IsCyrillic}")), whole).otherwise(made)
    return F.concat(title, made)


def kind_of(x: Column) -> Column:
    whole = lambda p: F.rlike(x, F.lit(f"^(?:{p})$"))
    return (
        F.when(F.contains(x, F.lit("@")), "email").when(whole(SECRET), "secret").when(whole(IBAN), "iban").when(F.startswith(x, F.lit("+")) | whole(NATIONAL), "phone")
        .when(whole(IPV6), "ipv6").when(whole(IP), "ip").when(whole(SSN), "ssn").when(whole(CARD), "card").otherwise("name")
    )


def canonical(x: Column, kind: Column) -> Column:
    """What two writings of one entity share: no title, no case of an address, no separators, no country code 1."""
    number = F.concat(F.when(_code(x) != "1", _code(x)).otherwise(""), F.substr(_digits(x), F.length(_code(x)) + 1, F.length(x)))
    plain = F.when(kind == "name", _bare(x)).when(kind.isin("email", "ipv6"), F.lower(x)).when(kind == "phone", number)
    return plain.when(kind.isin("card", "iban", "ssn"), F.regexp_replace(x, "[ -]", "")).otherwise(x)


def surrogate(x: Column, key: str, plan: Plan = Plan()) -> Column:
    kind, numbers = kind_of(x), f"{key}|{plan.round}"
    ssn = fill_digits(x, permute_digits(_digits(x), numbers, "ssn"))
    return _let(
        kind,
        lambda k: F.when(k == "email", _email(x, key, plan.width)).when(k == "secret", _secret(x, key)).when(k == "phone", _phone(x, numbers)).when(k == "ip", _ip(x, numbers))
        .when(k == "ssn", ssn).when(k == "card", _card(x, numbers)).when(k == "iban", _iban(x, numbers)).when(k == "ipv6", _ipv6(x, key)).otherwise(_name(x, key, plan.width)),
    )


def _found(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def conflicts(entities: DataFrame, key: str, plan: Plan) -> dict[str, int]:
    """Of distinct entities (kind, value, x): how many surrogates are shared (hashed), are a real entity (hashed and
    numbers), or are the number itself (same)."""
    digits = F.col("kind").isin(*DIGITS)
    made = entities.select("kind", "value", surrogate(F.col("x"), key, plan).alias("s")).select("kind", "value", canonical(F.col("s"), F.col("kind")).alias("v"))
    low = F.when(digits, F.col("v")).otherwise(F.lower("v"))
    both = made.select("kind", low.alias("v"), F.lit(1).alias("made"), (F.col("v") == F.col("value")).alias("same"))
    both = both.unionByName(entities.select("kind", F.when(digits, F.col("value")).otherwise(F.lower("value")).alias("v"), F.lit(0).alias("made"), F.lit(False).alias("same")))
    g = both.groupBy("kind", "v").agg(F.sum("made").alias("made"), F.count("*").alias("n"), F.bool_or("same").alias("same"))
    real = (F.col("made") > 0) & (F.col("n") > F.col("made"))
    r = g.agg(F.count_if(~digits & ((F.col("made") > 1) | real)).alias("hashed"), F.count_if(digits & real).alias("numbers"), F.count_if(digits & F.col("same")).alias("same")).first()
    return r.asDict()


def find_plan(docs: DataFrame, key: str, text_col: str = "text") -> Plan:
    """The narrowest hash and first bijection whose surrogates are distinct and, as far as the numbers allow, no real entity.

    Only distinct entities are shuffled and stored. The check is exact and covers the whole table.
    """
    x = docs.select(F.explode(_found(F.col(text_col).cast("string"))).alias("x")).select("x", kind_of(F.col("x")).alias("kind"))
    entities = stored(x.groupBy("kind", canonical(F.col("x"), F.col("kind")).alias("value")).agg(F.min("x").alias("x")), "entities")
    plan, usable = Plan(), None
    for _ in range(ROUNDS + (MOST - WIDTH) // 6):
        bad = conflicts(entities, key, plan)
        if not bad["same"] and usable is None:
            usable = plan.round
        done = not bad["numbers"] or plan.round + 1 == ROUNDS
        if done and not bad["hashed"]:
            if bad["numbers"]:  # no bijection avoids all real numbers: the first that moves each of them
                if usable is None:
                    raise ValueError("every bijection tried leaves some number as it is")
                return Plan(plan.width, usable)
            return plan
        plan = Plan(plan.width + 6 * bool(bad["hashed"]), plan.round + (not done))
        if plan.width > MOST:
            break
    raise ValueError("surrogates still collide at the largest width")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """docs with every detected entity replaced, and n_entities (long). Without a plan it is found first."""
    if not key:
        raise ValueError("a key is needed")
    if plan is None:
        plan = find_plan(docs, key, text_col)
    df = docs.drop("n_entities")
    found, text = fresh(df, "_entities"), F.col(text_col).cast("string")
    df = df.select("*", F.explode(F.array(_found(text))).alias(found))
    made = F.transform(found, lambda x: surrogate(x, key, plan))
    joined = F.array_join(F.zip_with(F.split(text, ENTITY, -1), F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    df = df.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(text))
    return df.withColumn("n_entities", F.greatest(F.size(found), F.lit(0)).cast("long")).drop(found)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark)).select("doc_id", "text", "n_entities")
