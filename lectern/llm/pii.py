"""Format-preserving pseudonyms: a keyed Feistel permutation of personal numbers, dates and addresses.

Built-in expressions only: a row is changed where it lies, without a shuffle and without Python tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of the permutation. A deployment passes its own.
KEY = "pseudonym-key-1"
ROUNDS = 8
#: Characters of an account number by country; the printed form has groups of four.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
PRINTED = "|".join(
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"\b"
    for n, names in IBAN_LENGTHS.items()
)
# What a candidate looks like, tried in this order. Whether it is one, the validation says.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "iso_date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "dot_date": r"\b[0-9]{2}[./][0-9]{2}[./][0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "iban": rf"\b(?:{PRINTED}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,4}})?))\b",
    "nanp": r"(?:\+1[ .-]?)?\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}\b|\+1[ .-]?[2-9][0-9]{2}[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}\b|\b[2-9][0-9]{2}[.-][2-9][0-9]{2}[.-][0-9]{4}\b",
    "phone": r"\+(?![0-9 .()-]{0,4}[0-9]{13})(?=(?:[ .()-]{0,2}[0-9]){8,15}(?![ .-]?[0-9]))[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b",
    # a whole run of digit groups, which is searched group by group; it leaves the start of a date or an address alone
    "run": r"\b[0-9][0-9 -]{11,}[0-9]\b(?![./][0-9])(?![A-Za-z0-9._%+-]{0,64}@)",
}
#: What may start at a group of a run: a card as it is printed or of one group, or another value of digits and dashes.
CARD_SHAPE = r"^(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
INNER = ["iso_date", "ssn", "nanp"]
CANDIDATE = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days that dates are permuted in: 270 x 270 of them from 1900-01-01 on.
FIRST_DAY, DAY_RADIX = "1900-01-01", 270


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shift(key: str, turn: Column, other: Column, mine: Column, radices: Column) -> Column:
    """One round: each symbol of `mine` moves within its radix by a keyed hash of the `other` half."""
    seed = F.concat_ws(":", F.lit(key), turn, F.size(mine), F.array_join(other.cast("array<string>"), ","))
    return let(
        F.sha2(seed, 512),
        lambda digest: F.transform(mine, lambda v, i: F.pmod(
            v + F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.element_at(radices, i + 1))),
    )


def feistel(symbols: Column, radices: Column, key: str) -> Column:
    """A keyed permutation of arrays of symbols, each below its radix: an alternating Feistel network on two halves.

    A radix of 1 leaves its symbol 0, so signs between the digits take part without change.
    """
    half = F.ceil(F.size(symbols) / 2).cast("int")
    first = lambda a: F.slice(a, F.lit(1), half)
    second = lambda a: F.slice(a, half + 1, F.size(a))
    start = F.struct(first(symbols).alias("a"), second(symbols).alias("b"))

    def turn(state: Column, k: Column) -> Column:
        left = F.struct(shift(key, k, state["b"], state["a"], first(radices)).alias("a"), state["b"].alias("b"))
        right = F.struct(state["a"].alias("a"), shift(key, k, state["a"], state["b"], second(radices)).alias("b"))
        return F.when(k % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def permute_numbers(numbers: list[Column], radices: list[int], key: str) -> Column:
    return feistel(F.array(*[n.cast("int") for n in numbers]), F.array(*map(F.lit, radices)), key)


def permute_characters(text: Column, begin, end, key: str) -> Column:
    """Digits and ASCII letters of `text` from position `begin` to before `end` (from 1), each within its class."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))

    def build(codes: Column) -> Column:
        def kind(code: Column, i: Column) -> Column:
            within = (i + 1 >= begin) & (i + 1 < end)
            return (
                F.when(within & code.between(48, 57), F.struct(F.lit(48).alias("base"), F.lit(10).alias("radix")))
                .when(within & code.between(97, 122), F.struct(F.lit(97).alias("base"), F.lit(26).alias("radix")))
                .when(within & code.between(65, 90), F.struct(F.lit(65).alias("base"), F.lit(26).alias("radix")))
                .otherwise(F.struct(code.alias("base"), F.lit(1).alias("radix")))
            )

        def render(kinds: Column) -> Column:
            symbols = F.zip_with(codes, kinds, lambda c, k: c - k["base"])
            moved = feistel(symbols, F.transform(kinds, lambda k: k["radix"]), key)
            return F.array_join(F.zip_with(moved, kinds, lambda v, k: F.char(v + k["base"])), "")

        return let(F.transform(codes, kind), render)

    return let(codes, build)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def digit_sum(number: Column) -> Column:
    """Luhn's sum of a string of digits."""
    values = F.reverse(F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(number, i, F.lit(1)).cast("int")))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def modulo_97(account: Column) -> Column:
    """ISO 7064 remainder of an account number whose first four characters are moved to its end."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    parts = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    return F.aggregate(parts, F.lit(0), lambda s, c: F.when(c < 65, (s * 10 + c - 48) % 97).otherwise((s * 100 + c - 55) % 97))


def group(text: Column, k: int, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, k)


def spread_digits(form: Column, new: Column) -> Column:
    """`form` with its digits replaced by those of `new`, one by one."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.length(form)), F.struct(F.lit("").alias("text"), F.lit(1).alias("next")),
        lambda s, i: F.when(
            F.substring(form, i, F.lit(1)).between("0", "9"),
            F.struct(F.concat(s["text"], F.substring(new, s["next"], F.lit(1))).alias("text"), (s["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(s["text"], F.substring(form, i, F.lit(1))).alias("text"), s["next"].alias("next"))),
    )
    return steps["text"]


def email(hit: Column, key: str) -> Column:
    return permute_characters(hit, F.lit(1), F.instr(hit, "@"), key)


def ip(hit: Column, key: str) -> Column:
    parts = F.split(hit, "\\.").cast("array<int>")
    valid = F.array_max(parts) < 256
    return F.when(valid, F.array_join(feistel(parts, F.array(*[F.lit(256)] * 4), key).cast("array<string>"), ".")).otherwise(hit)


def moved_day(day: Column, key: str, form: Column, original: Column) -> Column:
    """`day` permuted and written by `form`; a day that does not exist, or outside the range, stays."""
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    valid = number.between(0, DAY_RADIX**2 - 1)
    new = permute_numbers([F.floor(number / DAY_RADIX), number % DAY_RADIX], [DAY_RADIX, DAY_RADIX], key)
    moved = let(new, lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), F.element_at(n, 1) * DAY_RADIX + F.element_at(n, 2)))
    written = let(moved, lambda d: F.when(form == "-", F.date_format(d, "yyyy-MM-dd")).when(form == ".", F.date_format(d, "dd.MM.yyyy"))
                  .when(form == "d", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
    return F.when(valid, written).otherwise(original)


def iso_date(hit: Column, key: str) -> Column:
    return let(F.try_to_date(hit, "yyyy-MM-dd"), lambda d: moved_day(d, key, F.lit("-"), hit))


def dot_date(hit: Column, key: str) -> Column:
    """Day, month, year between dots; month, day, year between slashes, or day first where that is no date; mixed signs
    are no date."""
    form = F.substring(hit, 3, 1)
    same = form == F.substring(hit, 6, 1)
    month_first = F.try_to_date(hit, "MM/dd/yyyy")
    day = F.when(same & (form == "."), F.try_to_date(hit, "dd.MM.yyyy")).when(same, F.coalesce(month_first, F.try_to_date(hit, "dd/MM/yyyy")))
    form = F.when((form == "/") & month_first.isNull(), F.lit("d")).otherwise(form)
    return let(day, lambda d: moved_day(d, key, form, hit))


def ssn(hit: Column, key: str) -> Column:
    """Area 001-899 but 666, group 01-99, serial 0001-9999; permuted among the valid ones."""
    area, pair, serial = (F.element_at(F.split(hit, "-").cast("array<int>"), k) for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (pair > 0) & (serial > 0)
    new = permute_numbers([area - 1 - (area > 666).cast("int"), pair - 1, serial - 1], [898, 99, 9999], key)
    shown = let(new, lambda n: F.concat(
        F.lpad((F.element_at(n, 1) + 1 + (F.element_at(n, 1) >= 665).cast("int")).cast("string"), 3, "0"), F.lit("-"),
        F.lpad((F.element_at(n, 2) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.element_at(n, 3) + 1).cast("string"), 4, "0")))
    return F.when(valid, shown).otherwise(hit)


def iban(hit: Column, key: str) -> Column:
    """The national part moves, the country stays, the check digits are made anew; groups of four stay groups."""
    bare = F.translate(hit, " ", "")
    moved = permute_characters(bare, F.lit(5), F.lit(99), key)
    spaced = lambda a: F.when(F.contains(hit, F.lit(" ")), F.regexp_replace(a, "(.{4})(?=.)", "$1 ")).otherwise(a)

    def checked(account: Column) -> Column:
        bare = F.concat(F.substring(account, 1, 2), F.lit("00"), F.substring(account, 5, 40))
        check = F.lpad((98 - modulo_97(bare)).cast("string"), 2, "0")
        return F.concat(F.substring(account, 1, 2), check, F.substring(account, 5, 40))

    return F.when(modulo_97(bare) == 1, spaced(let(moved, checked))).otherwise(hit)


def nanp(hit: Column, key: str) -> Column:
    """Area code and exchange stay within 200-999; country code and signs stay."""
    plus = F.when(hit.startswith("+1"), F.lit("+1")).otherwise(F.lit(""))
    form = F.substring(hit, F.length(plus) + 1, F.lit(40))
    bare = digits(form)
    parts = [F.substring(bare, 1, 3).cast("int") - 200, F.substring(bare, 4, 3).cast("int") - 200, F.substring(bare, 7, 4).cast("int")]
    new = let(permute_numbers(parts, [800, 800, 10000], key), lambda n: F.concat(
        (F.element_at(n, 1) + 200).cast("string"), (F.element_at(n, 2) + 200).cast("string"), F.lpad(F.element_at(n, 3).cast("string"), 4, "0")))
    return F.concat(plus, spread_digits(form, new))


def phone(hit: Column, key: str) -> Column:
    """The country code stays; 8 to 15 digits in all."""
    code = F.length(group(hit, 1, r"^(\+[0-9]{1,3})"))
    new = permute_characters(digits(F.substring(hit, code + 1, F.lit(60))), F.lit(1), F.lit(99), key)
    moved = F.concat(F.substring(hit, F.lit(1), code), spread_digits(F.substring(hit, code + 1, F.lit(60)), new))
    return F.when(F.length(digits(hit)).between(8, 15), moved).otherwise(hit)


def card(hit: Column, key: str) -> Column:
    """A number that passes Luhn's check: all digits but the last are permuted and the last is made anew."""
    bare = digits(hit)
    moved = permute_characters(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(1), F.lit(99), key)
    whole = let(moved, lambda m: F.concat(m, F.pmod(-digit_sum(F.concat(m, F.lit("0"))), F.lit(10)).cast("string")))
    return spread_digits(hit, whole)


KINDS = {"email": email, "ip": ip, "iso_date": iso_date, "dot_date": dot_date, "ssn": ssn, "iban": iban, "nanp": nanp, "phone": phone}


def moved(name: str, hit: Column, key: str) -> Column:
    domain = "date" if name.endswith("date") else name  # a date moves alike in every notation
    return KINDS[name](hit, f"{key}:{domain}")


def luhn(text: Column) -> Column:
    return F.when(F.length(text) > 0, digit_sum(digits(text)) % 10 == 0).otherwise(False)


def run(hit: Column, key: str) -> Column:
    """A run of digit groups with its values replaced, and how many they are.

    At each group, from left to right: a valid card of a fixed shape, or a valid date, social security or phone
    number, or the longest valid card of any grouping that holds none of these. Where nothing starts, the next group
    is tried.
    """
    none = F.struct(F.lit("").alias("old"), F.lit("").alias("new"))

    def inner(name: str, rest: Column) -> Column:
        one = F.regexp_extract(rest, f"^(?:{PATTERNS[name]})(?![0-9])", 0)
        new = F.when(F.length(one) > 0, moved(name, one, key))
        return let(new, lambda n: F.when(n != one, F.struct(one.alias("old"), n.alias("new"))))

    def strong(rest: Column) -> Column:
        shape = F.regexp_extract(rest, CARD_SHAPE, 0)
        found = F.when(luhn(shape), F.struct(shape.alias("old"), card(shape, f"{key}:card").alias("new")))
        return F.coalesce(found, *[inner(name, rest) for name in INNER], none)

    def search(groups: Column, rests: Column) -> Column:
        def walk(strongs: Column) -> Column:
            def free(i: Column, rest: Column) -> Column:
                tries = F.array(*[F.regexp_extract(rest, f"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(19, 12, -1)])
                inside = lambda t: F.slice(strongs, i + 2, F.size(F.split(t, "[ -]")) - 1)
                good = F.filter(tries, lambda t: luhn(t) & ~F.exists(inside(t), lambda x: x["old"] != ""))
                return let(good, lambda g: F.when(F.size(g) > 0, let(F.get(g, F.lit(0)), lambda t: F.struct(t.alias("old"), card(t, f"{key}:card").alias("new")))).otherwise(none))

            found = F.transform(strongs, lambda x, i: F.when(x["old"] != "", x).otherwise(free(i, F.get(rests, i))))
            start = F.struct(F.lit("").alias("text"), F.lit(0).alias("skip"), F.lit(0).alias("n"))

            def step(state: Column, item: Column) -> Column:
                size = F.length(digits(item["group"]))
                gap = F.regexp_extract(item["group"], "[^0-9]*$", 0)
                begins = (state["skip"] == 0) & (item["hit"]["old"] != "")
                left = F.when(begins, F.length(digits(item["hit"]["old"])) - size).otherwise(F.greatest(state["skip"] - size, F.lit(0)))
                # a value stands for its groups and what lies between them, the gap behind its last group stays
                put = F.when(begins, item["hit"]["new"]).when(state["skip"] == 0, item["group"]).otherwise("")
                taken = begins | (state["skip"] > 0)
                tail = F.when(taken & (left == 0), gap).otherwise("")
                return F.struct(F.concat(state["text"], put, tail).alias("text"), left.alias("skip"), (state["n"] + begins.cast("int")).alias("n"))

            items = F.zip_with(groups, found, lambda g, h: F.struct(g.alias("group"), h.alias("hit")))
            return let(F.aggregate(items, start, step), lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n")))

        return let(F.transform(rests, strong), walk)

    # each group with the gap behind it, and the 40 characters that start with it: a card has 19 digits and 18 gaps
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+[^0-9]*"), F.lit(0))
    rests = F.regexp_extract_all(hit, F.lit("(?=(.{1,40}))[0-9]+[^0-9]*"), F.lit(1))
    return let(groups, lambda g: let(rests, lambda r: search(g, r)))


def pseudonym(hit: Column, key: str) -> Column:
    """The text that stands for one candidate, the candidate itself where validation fails, and how many values moved."""
    counted = lambda new: let(new, lambda t: F.struct(t.alias("text"), (t != hit).cast("int").alias("n")))
    chosen = run(hit, key)
    for name in reversed(KINDS):
        chosen = F.when(hit.rlike(f"^(?:{PATTERNS[name]})$"), counted(moved(name, hit, key))).otherwise(chosen)
    return chosen


def pseudonymise_text(text: Column, key: str = KEY) -> tuple[Column, Column]:
    """The text with its pseudonyms, and how many there are."""
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def put(hits: Column) -> Column:
        def with_new(new: Column) -> Column:
            pieces = F.split(text, CANDIDATE, -1)
            joined = F.array_join(F.zip_with(pieces, F.concat(F.transform(new, lambda x: x["text"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
            changed = F.aggregate(new, F.lit(0), lambda s, x: s + x["n"])
            return F.struct(joined.alias("text"), changed.alias("n"))

        return let(F.transform(hits, lambda h: pseudonym(h, key)), with_new)

    plain = F.struct(text.alias("text"), F.lit(0).alias("n"))
    done = let(hits, lambda h: F.when(F.size(h) > 0, put(h)).otherwise(plain))
    return done


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str = KEY, count: str | None = "n_pseudonyms") -> DataFrame:
    """`docs` with the personal numbers of `text` replaced by pseudonyms of the same format.

    Mail addresses (local part), internet addresses, dates, social security numbers, account numbers (check digits),
    phone numbers and payment cards (Luhn's check) are validated and then permuted under `key` within their format,
    so equal values get equal pseudonyms in every document, and different values different ones. What fails its
    validation stays as it is, and the search goes on behind its first group of digits. A slash date is read month
    first, whatever the language, and day first only where that is no date; written day first it can look like another. `count` names a column for the number of values that changed; None leaves it out, and
    an existing column of this name is replaced. All other columns stay, whatever their names.

    A null text stays null with 0 pseudonyms, an empty one stays empty. Texts are read whole; time is linear in the
    length, but for unbroken runs of digit groups, which are copied once for each group. Repeated rows are treated alike. An empty table gives an empty table.
    """
    done = F.when(F.col(text).isNotNull(), pseudonymise_text(F.col(text), key))
    name = "_pseudonyms"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, done).withColumn(text, F.col(f"{name}.text"))
    if count is not None:
        out = out.withColumn(count, F.coalesce(F.col(f"{name}.n"), F.lit(0)))
    return out.drop(name)


def pseudonymise_query(documents: DataFrame) -> DataFrame:
    return pseudonymise(documents.select("doc_id", "text"))
