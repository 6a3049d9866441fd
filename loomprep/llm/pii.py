"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates are first validated (check digits, ranges, calendars), then permuted inside the set of valid values of
the same format by a keyed Feistel network: equal values get equal pseudonyms in all documents, different values get
different ones, and the key undoes it. E-mail addresses and secrets are permuted letter by letter within their classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loomprep.llm.common import spare

ROUNDS = 8
MARK, KEPT, CUT = "\ue000", "\ue001", "\ue002"  # a mark in a text becomes MARK KEPT; MARK CUT stands around a finding
DAYS = (189, 773)  # their product is the number of days in 400 years
LATE_DAYS = (9, 9833)  # their product is the number of those after the 12th of a month
WINDOW, LONGEST = 256, 72  # characters: a block of a run, and more than any account or card number takes
EPOCH = "DATE'1700-01-01'"
# Candidates, by kind; what a pattern finds still has to be validated.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
_ENDS = r"(?:(?![\w-]|[./]\d)|(?<![ -]\d{1,3})(?![\w-]))"
_CHUNK = rf"\d++(?:-\d++)*+{_ENDS}"
RUN = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}}){_CHUNK}(?: {_CHUNK})*+(?<=\d{r'[ -]?\d' * 12})"  # digit groups, however many; may hold a card and more
PHONE = r"(?<![\w+(])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.-])(?:\d{3}\.\d{3}\.|[2-9]\d{2} \d{3} )\d{4}(?![\w-]|\.\d)"
SECRET = r"(?i:\b(?:password|passwd|secret|token|api[_-]?key)\b\s{0,4}[=:]\s{0,4}[\"']?)[A-Za-z0-9_+/-]{8,}|\bAKIA[A-Z0-9]{16}\b"
SECRET_HEAD = r"^((?i:[a-z_-]+\s{0,4}[=:]\s{0,4}[\"']?)|AKIA)"
FINDINGS = "|".join(f"(?:{p})" for p in (EMAIL, IBAN, DATE, SSN, ADDRESS, RUN, PHONE, SECRET))
INNER = "|".join(f"(?:{p})" for p in (EMAIL, DATE, SSN, ADDRESS, PHONE, SECRET))
#: Usual groups of card numbers, in the order in which they are tried; then any groups, by the number of digits.
USUAL_CARDS = (r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", r"\d{4}([ -])\d{6}\1\d{5}", r"\d{13,19}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}")
ANY_CARDS = tuple(rf"\d(?:[ -]?\d){{{n - 1}}}" for n in range(19, 12, -1))
COUNTRIES = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
             23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL",
             29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC"}
ACCOUNTS = tuple(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in COUNTRIES.items()) + tuple(
    rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n in range(34, 14, -1)
)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("bigint")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_a(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def shifted(part: Column, bases: Column, drawn: Column, sign: int, width: int) -> Column:
    """Each number moved by its own hex digits of the round, within its base."""
    places = 128 // width

    def move(digits: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            share = F.conv(F.substr(digits, 1 + width * (i % places), F.lit(width)), 16, 10).cast("bigint")
            return F.pmod(value + sign * share, F.get(bases, i))

        return F.transform(part, one)

    return bound(drawn, move)


def feistel(values: Column, bases: Column, key: str, tweak: Column, undo: bool, width: int = 4) -> Column:
    """A keyed permutation of the arrays of longs below ``bases``: the halves are shifted in turn, each by a hash of the
    key, the format, the round and the other half."""

    def halves(both: Column) -> Column:
        size = F.size(both["v"])
        half = F.ceil(size / 2).cast("int")
        rest = size - half
        parts = {"l": ("v", F.lit(1), half), "r": ("v", half + 1, rest), "left": ("b", F.lit(1), half), "right": ("b", half + 1, rest)}
        return F.struct(*[F.slice(both[c], start, n).alias(name) for name, (c, start, n) in parts.items()], both["t"].alias("t"))

    sign = -1 if undo else 1

    def drawn(state: Column, other: str, step: Column) -> Column:
        said = F.array_join(state[other].cast("array<string>"), ",")
        return F.sha2(F.concat_ws("|", F.lit(key), state["t"], step.cast("string"), said).cast("binary"), 512)

    def turn(s: Column, step: Column) -> Column:
        odd = step % 2 == 1
        return F.struct(
            F.when(odd, s["l"]).otherwise(shifted(s["l"], s["left"], drawn(s, "r", step), sign, width)).alias("l"),
            F.when(odd, shifted(s["r"], s["right"], drawn(s, "l", step), sign, width)).otherwise(s["r"]).alias("r"),
            s["left"].alias("left"),
            s["right"].alias("right"),
            s["t"].alias("t"),
        )

    steps = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    start = bound(F.struct(values.alias("v"), bases.alias("b"), tweak.alias("t")), halves)
    return F.aggregate(F.array(*map(F.lit, steps)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def pair(value: Column, sizes: tuple[int, int], key: str, kind: str, undo: bool) -> Column:
    """A number below the product of ``sizes``, permuted."""
    parts = bound(value, lambda v: F.array(long(F.floor(v / sizes[1])), long(v % sizes[1])))
    moved = feistel(parts, F.array(long(sizes[0]), long(sizes[1])), key, F.lit(kind), undo, width=15)
    return F.aggregate(moved, long(0), lambda total, x: total * sizes[1] + x)


def by_class(text: Column, key: str, kind: str, undo: bool, leading: bool = False) -> Column:
    """Letters and digits permuted among small letters, capitals and digits; all else stays in its place.

    With ``leading``, the first digit of a group stays in 0-1 or in 2-9, as numbering plans ask.
    """

    def cell(own: Column, i: Column) -> Column:
        c = F.substr(own, i, F.lit(1))
        digit = c.rlike("[0-9]")
        alphabet = F.when(digit, DIGITS).when(c.rlike("[a-z]"), LOWER).when(c.rlike("[A-Z]"), UPPER).otherwise(c)
        low, base = F.lit(0), F.length(alphabet)
        if leading:
            first = digit & ~F.substr(own, F.greatest(i - 1, F.lit(1)), F.least(i - 1, F.lit(1))).rlike("[0-9]")
            low = F.when(first & ~c.isin("0", "1"), 2).otherwise(0)
            base = F.when(first, F.when(c.isin("0", "1"), 2).otherwise(8)).otherwise(base)
        at = F.position(c, alphabet) - 1 - low
        return F.struct(alphabet.alias("alphabet"), low.alias("low"), long(base).alias("base"), long(at).alias("at"))

    def moved(own: Column, cells: Column) -> Column:
        shape = F.translate(own, LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "9" * 10)
        made = feistel(cells["at"], cells["base"], key, F.concat(F.lit(f"{kind}:"), shape), undo)
        return F.array_join(F.zip_with(cells, made, lambda x, m: F.substr(x["alphabet"], (x["low"] + m + 1).cast("int"), F.lit(1))), "")

    def whole(own: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(1), F.length(own)), lambda i: cell(own, i))
        return F.when(F.length(own) == 0, own).otherwise(bound(cells, lambda c: moved(own, c)))

    return bound(text, whole)


def check_digit(payload: Column) -> Column:
    """Luhn's check digit of a string of digits."""

    def summed(own: Column) -> Column:
        n = F.length(own)

        def add(total: Column, i: Column) -> Column:
            d = F.substr(own, n - i + 1, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return ((10 - bound(payload, summed) % 10) % 10).cast("string")


def mod_97(text: Column) -> Column:
    """Remainder of an account number by 97, letters counting from 10."""

    def summed(own: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            c = F.substr(own, i, F.lit(1))
            letter = total * 100 + F.position(c, F.lit(UPPER)) + 9
            return F.when(c.rlike("[0-9]"), total * 10 + F.position(c, F.lit(DIGITS)) - 1).otherwise(letter) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(own)), F.lit(0), add)

    return bound(text, summed)


def card(text: Column, key: str, undo: bool) -> Column:
    """First six digits stay, the check digit is computed anew."""
    head = F.regexp_extract(text, r"^(?:\d[ -]?){6}", 0)
    body = F.substr(text, F.length(head) + 1, F.length(text) - F.length(head) - 1)
    made = F.concat(head, by_class(body, key, "card", undo))
    return bound(made, lambda m: F.concat(m, check_digit(F.regexp_replace(m, "[ -]", ""))))


def iban(text: Column, key: str, undo: bool) -> Column:
    """The country stays, the check digits are computed anew."""
    country, made = F.substr(text, F.lit(1), F.lit(2)), by_class(F.substr(text, F.lit(5)), key, "iban", undo)

    def checked(own: Column) -> Column:
        check = 98 - mod_97(F.concat(F.replace(own, F.lit(" "), F.lit("")), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), own)

    return bound(made, checked)


def ssn(text: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.substr(text, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    inner = 99 * 9999
    value = long(area - 1 - (area > 666).cast("int")) * inner + (group - 1) * 9999 + (serial - 1)

    def shown(x: Column) -> Column:
        place = F.floor(x / inner).cast("int") + 1
        parts = (place + (place >= 666).cast("int"), F.floor(x % inner / 9999).cast("int") + 1, (x % 9999).cast("int") + 1)
        return F.format_string("%03d-%02d-%04d", *parts)

    return bound(pair(value, (898, inner), key, "ssn", undo), shown)


def calendar_day(text: Column, order: str) -> Column:
    return F.try_to_timestamp(text, F.lit(order)).cast("date")


def date(text: Column, order: str, key: str, undo: bool) -> Column:
    number = F.date_diff(calendar_day(text, order), F.expr(EPOCH))
    moved = pair(long(number), DAYS, key, order, undo).cast("int")
    return F.date_format(F.date_add(F.expr(EPOCH), moved), order)


def month_first(text: Column, key: str, undo: bool) -> Column:
    """A day after the 12th of its month, which only the month-first reading allows, for another such day."""

    def first(month: Column) -> Column:
        """Number of late days before a month, both counted from 1700."""
        return F.date_diff(F.add_months(F.expr(EPOCH), month), F.expr(EPOCH)) - 12 * month

    def numbered(day: Column) -> Column:
        month = (F.year(day) - 1700) * 12 + F.month(day) - 1
        return long(first(month) + F.dayofmonth(day) - 13)

    def shown(number: Column) -> Column:
        about = F.floor(number * 4800 / (LATE_DAYS[0] * LATE_DAYS[1])).cast("int")
        month = F.when(first(about + 1) <= number, about + 1).when(first(about) <= number, about).otherwise(about - 1)
        start = F.date_add(F.add_months(F.expr(EPOCH), month), F.lit(12))
        return F.date_format(F.date_add(start, (number - first(month)).cast("int")), "MM/dd/yyyy")

    number = bound(calendar_day(text, "MM/dd/yyyy"), numbered)
    return bound(pair(number, LATE_DAYS, key, "month-first", undo), shown)


def address(text: Column, key: str, undo: bool) -> Column:
    octets = F.transform(F.split(text, "[.]"), long)
    moved = feistel(octets, F.array(*[long(256)] * 4), key, F.lit("address"), undo)
    return F.array_join(moved.cast("array<string>"), ".")


def true_card(x: Column) -> Column:
    digits = F.regexp_replace(x, "[ -]", "")
    return F.substr(digits, F.length(digits)) == check_digit(F.substr(digits, F.lit(1), F.length(digits) - 1))


def true_iban(x: Column) -> Column:
    bare = F.replace(x, F.lit(" "), F.lit(""))
    return mod_97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1


def taken_out(text: Column, patterns: tuple[str, ...], true: Callable[[Column], Column]) -> Column:
    """``text`` as texts and findings in turn. At every start of a group, from the left, the first pattern is taken that
    ends with a group and whose match is ``true``."""
    shapes = F.array(*[F.lit(f"^{p}(?![A-Za-z0-9])") for p in patterns])

    def scan(x: Column) -> Column:
        own, blocks = x["own"], x["blocks"]

        def first(i: Column) -> Column:
            block = F.floor((i - 1) / WINDOW).cast("int")
            near = F.substr(F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit(""))), (i - 1) % WINDOW + 1, F.lit(LONGEST))
            matches = bound(near, lambda n: F.transform(shapes, lambda p: F.regexp_substr(n, p)))
            return F.get(F.filter(matches, lambda m: m.isNotNull() & true(m)), F.lit(0))

        def step(s: Column, i: Column) -> Column:
            def add(found: Column) -> Column:
                more = F.array(F.substr(own, s["at"], i - s["at"]), found)
                longer = F.struct((i + F.length(found)).alias("at"), F.concat(s["parts"], more).alias("parts"))
                return F.when(found.isNull(), s).otherwise(longer)

            return F.when(i < s["at"], s).otherwise(bound(first(i), add))

        def behind_separators(block: Column, b: Column) -> Column:
            places = F.filter(F.sequence(F.lit(1), F.length(block)), lambda j: F.substr(block, j, F.lit(1)).isin(" ", "-"))
            return F.transform(places, lambda j: b * WINDOW + j + 1)

        starts = F.concat(F.array(F.lit(1)), F.flatten(F.transform(blocks, behind_separators)))
        none = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(starts, none, step, lambda s: F.concat(s["parts"], F.array(F.substr(own, s["at"]))))

    # A run of any length is looked at through windows of two blocks, so that a start costs the same wherever it lies.
    cut = F.struct(text.alias("own"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0)).alias("blocks"))
    return F.when(F.length(text) < 13, F.array(text)).otherwise(bound(cut, scan))


def cut_at(text: Column, pattern: str) -> Column:
    """``text`` as texts and candidates of the pattern in turn."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}{CUT}$1{MARK}{CUT}"), MARK + CUT)


def recut(x: Column) -> Column:
    """A candidate that is no valid account or card number as a whole, as texts and findings in turn: account numbers, cards
    in usual groups, the other kinds, cards in any groups, each in what those before it left."""

    def among(parts: Column, use: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(use(p))))

    parts = F.when(x.rlike("[A-Z]"), taken_out(x, ACCOUNTS, true_iban)).otherwise(F.array(x))
    parts = among(parts, lambda p: taken_out(p, USUAL_CARDS, true_card))
    parts = among(parts, lambda p: cut_at(p, INNER))
    return among(parts, lambda p: taken_out(p, ANY_CARDS, true_card))


def pseudonym(x: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one candidate; a candidate that is not valid stays as it is."""
    octets = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    out = F.when(is_a(x, EMAIL), F.concat(by_class(F.regexp_extract(x, r"^(.*)\.", 1), key, "email", undo), F.regexp_extract(x, r"\.[^.]*$", 0)))
    out = out.when(is_a(x, IBAN) & true_iban(x), iban(x, key, undo))
    for order, shape in (("yyyy-MM-dd", r"\d{4}-\d\d-\d\d"), ("dd/MM/yyyy", r"\d\d/\d\d/\d{4}"), ("dd.MM.yyyy", r"\d\d\.\d\d\.\d{4}")):
        known = F.year(calendar_day(x, order)).between(1700, 2099)
        made = F.when(known, date(x, order, key, undo))
        if order == "dd/MM/yyyy":
            made = made.when(F.year(calendar_day(x, "MM/dd/yyyy")).between(1700, 2099), month_first(x, key, undo))
        out = out.when(is_a(x, shape), made.otherwise(x))
    out = out.when(is_a(x, SSN), F.when(x.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$"), ssn(x, key, undo)).otherwise(x))
    out = out.when(is_a(x, r"\d+(?:\.\d+){3}"), F.when(x.rlike(rf"^{octets}(?:\.{octets}){{3}}$"), address(x, key, undo)).otherwise(x))
    out = out.when(is_a(x, CARD) & true_card(x), card(x, key, undo))
    country = F.regexp_extract(x, r"^\+\d{1,3}", 0)
    out = out.when(is_a(x, PHONE), F.concat(country, by_class(F.substr(x, F.length(country) + 1), key, "phone", undo, leading=True)))
    head = F.regexp_extract(x, SECRET_HEAD, 0)
    return out.when(is_a(x, SECRET), F.concat(head, by_class(F.substr(x, F.length(head) + 1), key, "secret", undo))).otherwise(x)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None, undo: bool = False) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; with ``found_col``, also the number of values replaced.

    Handled: e-mail addresses (the last label stays), account numbers (IBAN), dates of 1700 to 2099 (year first, day first
    with / or ., or month first with / where no day-first date can be read: those are permuted among themselves), US social
    security numbers, IPv4 addresses, card numbers with a true check digit, telephone numbers (the country code stays; ten
    digits cut by blanks only with an area code from 200 on), passwords, tokens and access keys. Within
    a run of digit groups, of any length, or of capital groups the valid numbers are looked for at the groups' bounds, then
    the other kinds. What fails its validation, such as a number with a wrong check digit, stays. A null text stays null with 0 found.
    All other columns and rows stay as they are; a column that is named like ``found_col`` is replaced. ``undo`` with the
    same key restores the texts, unless a new number makes another choice of groups in its run valid as well.
    """
    text = F.col(text_col)
    guarded = F.replace(text, F.lit(MARK), F.lit(MARK + KEPT))
    names = [c for c in docs.columns if c != found_col]

    def opened(x: Column) -> Column:
        return F.concat(F.array(F.lit("")), recut(x), F.array(F.lit("")))

    def refined(parts: Column) -> Column:
        runs = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (is_a(x, IBAN) | is_a(x, RUN)), opened(x)).otherwise(F.array(x)))
        return F.when(F.size(parts) > 1, F.flatten(runs)).otherwise(parts)

    def replaced(parts: Column) -> Column:
        made = F.transform(parts, lambda x, i: F.when(i % 2 == 1, pseudonym(x, key, undo)).otherwise(x))
        return F.when(F.size(parts) > 1, made).otherwise(parts)

    parts, made = (spare(name, docs.columns) for name in ("_parts", "_made"))
    cut = docs.select(*names, bound(cut_at(guarded, FINDINGS), refined).alias(parts))
    cut = cut.select(*names, parts, bound(F.col(parts), replaced).alias(made))
    changed = F.coalesce(F.size(F.filter(F.zip_with(parts, made, lambda a, b: a != b), lambda x: x)), F.lit(0)).cast("bigint")
    whole = F.replace(F.array_join(made, ""), F.lit(MARK + KEPT), F.lit(MARK))
    shown = [whole.alias(c) if c == text_col else F.col(c) for c in names]
    return cut.select(*shown, *([changed.alias(found_col)] if found_col else []))
