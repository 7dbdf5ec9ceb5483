"""Personal data and secrets replaced by format-preserving Feistel pseudonyms, in column expressions only.

A value is found by one pattern, validated (Luhn sum, octets below 256, a date of the calendar, IBAN check number) and
its symbols are permuted by a keyed Feistel network over an alphabet of its own: decimal digits stay digits, hex stays
hex, separators and letter case stay in place, and check digits are computed anew, so the pseudonym is again valid.
The permutation depends on the key and the kind alone: equal values stay equal in all documents and different values
stay different, but that values which differ in the case of a letter only become equal where it turns into a digit. What fails its validation (a number without a right check digit, a version number) is left alone.

Kinds: email (the name before the @), phone, ip, card, ssn, iban, date, secret (a quoted or assigned key of 20 or
more characters). Defined results: a null text stays null, an empty one empty; rows are independent, so ties and
repeated rows change nothing; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LOWER = "0123456789abcdefghijklmnopqrstuvwxyz"
DAYS, DAY_HIGH, DAY_LOW = 73049, 17, 4297  # 1900-01-01 .. 2099-12-31 = 17 * 4297 days

# Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w-]|\.\d)"
IP = r"\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?![\w-])"


def _iban_pattern() -> str:
    """Exactly as many characters as the country has, in groups of four; of other countries as many as there are, but
    not past the start of a known one."""
    known = "|".join("|".join(countries.split()) for countries in IBAN_LENGTHS.values())
    fixed = [rf"(?:{'|'.join(countries.split())})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}"
             + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?!\w)" for n, countries in IBAN_LENGTHS.items()]
    start = rf"(?: (?!(?:{known})\d{{2}})| ?(?=\w)(?<! ))"
    other = rf"[A-Z]{{2}}\d{{2}}(?:{start}[A-Z0-9]{{4}}){{2,7}}(?:{start}[A-Z0-9]{{1,4}})?(?!\w)"
    return rf"(?<!\w)(?:{'|'.join(fixed)}|{other})"


def _run_pattern() -> str:
    """All numbers in a row of 13 digits or more, up to the next value of another kind. Which of them are cards is
    found by ``_cards``; possessive, so that long rows need no stack."""
    token = r"\d{1,19}+(?!\w)"
    return rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}})(?!(?:-?\d){{20}}){token}(?:[ -](?!{DATE}|{IP}|{SSN}){token})*+"


# Fixed patterns of the value formats.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "date": rf"(?<![\w.-]){DATE}",
    "ip": rf"(?<![\w.]){IP}",
    "ssn": rf"(?<![\w-]){SSN}",
    "iban": _iban_pattern(),
    "phone": r"(?<!\w)(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
             r"|(?<!\w)\+(?!1[ .(-])\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\w|[.-]\d)",
    "secret": r"(?i:(?<=(?:token|secret|passwd|password|apikey|api_key|api-key) ?[=:] ?[\"']?)[A-Za-z0-9_+/-]{20,}+)",
    "card": _run_pattern(),
}
ANY = "|".join(PATTERNS.values())


def _code(symbol: Column, alphabet: str) -> Column:
    return F.instr(F.lit(alphabet), symbol) - 1


def _added(part: Column, other: Column, round_: Column, alphabet: str, kind: str, key: str) -> Column:
    """Every symbol of ``part`` moved by a key stream drawn from the other half."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.length(part).cast("string"), round_.cast("string"), other), 256)
    base = len(alphabet)

    def moved(symbol: Column, i: Column) -> Column:
        step = F.conv(F.substring(stream, F.pmod(i * 4, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
        return F.substring(F.lit(alphabet), F.pmod(_code(symbol, alphabet) + step + (i * 4 / 60).cast("int"), F.lit(base)).cast("int") + 1, F.lit(1))

    return F.array_join(F.transform(F.when(F.length(part) > 0, F.split(part, "")).otherwise(F.array().cast("array<string>")), moved), "")


def feistel(value: Column, alphabet: str, kind: str, key: str) -> Column:
    """A keyed permutation of the strings over ``alphabet`` of each length: alternating rounds over two parts."""
    cut = (F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"),
                     F.substring(value, cut + 1, F.length(value)).alias("r"))

    def step(half: Column, i: Column) -> Column:
        odd = i % 2 == 1
        part, other = F.when(odd, half["l"]).otherwise(half["r"]), F.when(odd, half["r"]).otherwise(half["l"])
        new = _added(part, other, i, alphabet, kind, key)
        return F.struct(F.when(odd, new).otherwise(half["l"]).alias("l"), F.when(odd, half["r"]).otherwise(new).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda half: F.concat(half["l"], half["r"]))


def _refill(template: Column, symbols: Column, others: str) -> Column:
    """``symbols`` put in place of the template's characters that ``others`` does not match, with their case."""
    capitals = (template == F.upper(template)) & (template != F.lower(template))

    def put(c: Column, i: Column) -> Column:
        new = F.substring(symbols, F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), others, "")), F.lit(1))
        return F.when(c.rlike(others), c).when((c == F.lower(c)) & ~capitals, new).otherwise(F.upper(new))

    return F.array_join(F.transform(F.split(template, ""), put), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counting once."""
    places = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") >= 5, 1).otherwise(0))), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(
        F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + _code(F.lower(c), LOWER)), F.lit(97)).cast("int"))


def _day(date: Column, key: str) -> Column:
    """Another day of 1900 to 2099: a Feistel network over day = high * 4297 + low."""
    number = F.datediff(date, F.lit("1900-01-01").cast("date"))

    def drawn(round_: Column, other: Column, base: int) -> Column:
        return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("date"), round_.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("long"), F.lit(base))

    def step(h: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(h["h"] + drawn(i, h["l"], DAY_HIGH), F.lit(DAY_HIGH))).otherwise(h["h"]).alias("h"),
            F.when(odd, h["l"]).otherwise(F.pmod(h["l"] + drawn(i, h["h"], DAY_LOW), F.lit(DAY_LOW))).alias("l"))

    start = F.struct((number / DAY_LOW).cast("long").alias("h"), F.pmod(number, F.lit(DAY_LOW)).cast("long").alias("l"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step,
                       lambda h: F.date_add(F.lit("1900-01-01").cast("date"), (h["h"] * DAY_LOW + h["l"]).cast("int")))


def _kind(found: Column) -> Column:
    """The first kind whose whole pattern the value has and whose validation it passes; null if none."""
    def whole(name: str) -> Column:
        return found.rlike(f"^(?:{PATTERNS[name]})$")

    octets = F.forall(F.split(found, r"\."), lambda o: o.cast("int") < 256)
    sound = _date(found)
    bban = F.regexp_replace(found, " ", "")
    return (
        F.when(F.instr(found, "@") > 0, "email")
        .when(whole("date") & sound.isNotNull() & F.year(sound).between(1900, 2099), "date")
        .when(whole("ip") & octets, "ip")
        .when(whole("ssn"), "ssn")
        .when(whole("iban") & (_mod97(F.concat(F.substring(bban, F.lit(5), F.length(bban)), F.substring(bban, 1, 4))) == 1), "iban")
        .when(whole("phone"), "phone")
        .when(_sound_card(found), "card")
        .when(found.rlike("^[A-Za-z0-9_+/-]{20,}$") & ~found.rlike("^[0-9 -]{1,19}$"), "secret")
    )


def _sound_card(found: Column) -> Column:
    return found.rlike(r"^\d(?:[ -]?\d){12,18}$") & (_luhn(_digits(found)) % 10 == 0)


def _cards(run: Column) -> Column:
    """A row of numbers as parts (value, card): from the left the longest sound card that starts at a number. After the
    row's first number a card has groups of three digits or more, or any table of small numbers would hold some."""
    def split(tokens: Column) -> Column:
        joined = lambda i, n: F.regexp_replace(F.array_join(F.slice(tokens, i + 1, n), ""), "^[ -]", "")

        def sound(value: Column, i: Column) -> Column:
            return _sound_card(value) & ((i == 0) | ~value.rlike(r"\b\d{1,2}\b"))

        def step(state: Column, i: Column) -> Column:
            sizes = F.filter(F.sequence(F.least(F.lit(19), F.size(tokens) - i), F.lit(1), F.lit(-1)), lambda n: sound(joined(i, n), i))
            size = F.when(i >= state["next"], F.get(sizes, F.lit(0)))
            return F.when(size.isNull(), state).otherwise(F.struct(
                F.concat(state["found"], F.array(F.struct(state["next"].alias("low"), i.alias("at"), size.alias("n")))).alias("found"),
                (i + size).alias("next")))

        def parts(state: Column) -> Column:
            text = lambda low, n: F.array_join(F.slice(tokens, low + 1, n), "")
            own = F.flatten(F.transform(state["found"], lambda f: F.array(
                _part(F.concat(text(f["low"], f["at"] - f["low"]), F.regexp_extract(F.get(tokens, f["at"]), "^[ -]?", 0)), False),
                _part(joined(f["at"], f["n"]), True))))
            return F.concat(own, F.array(_part(text(state["next"], F.size(tokens) - state["next"]), False)))

        none = F.array().cast("array<struct<low:int,at:int,n:int>>")
        return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), F.struct(none.alias("found"), F.lit(0).alias("next")), step, parts)

    # Bound once by the lambda: the tokens are not found anew for each step.
    return F.flatten(F.transform(F.array(F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0))), split))


def _part(value: Column, card: bool) -> Column:
    return F.struct(value.alias("value"), F.lit(card).alias("card"))


def _parts(found: Column) -> Column:
    """A match as parts (value, kind): one, or of a row of numbers each card and what lies between."""
    run = found.rlike(r"^\d++(?:[ -]\d++)++$") & (found.contains(" ") | (F.length(found) < 20))
    kind = _kind(found)
    one = F.array(F.struct(found.alias("value"), kind.alias("kind")))
    return F.when(run & F.coalesce(~kind.isin("date", "ssn"), F.lit(True)), F.transform(_cards(found), lambda p: F.struct(
        p["value"].alias("value"), F.when(p["card"], "card").alias("kind")))).otherwise(one)


def _date(found: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(found, F.lit(p)) for p in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy"))).cast("date")


def _pseudonym(found: Column, kind: Column, key: str) -> Column:
    name = F.substring_index(found, "@", 1)
    inner = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    email = F.concat(_refill(name, feistel(inner, LOWER, "email", key), "[^A-Za-z0-9]"), F.substring(found, F.length(name) + 1, F.length(found)))

    octets = F.split(found, r"\.")
    packed = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.conv(o, 10, 16)), 2, "0")), "")
    mixed = feistel(packed, LOWER[:16], "ip", key)
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substring(mixed, i, F.lit(2)), 16, 10)), ".")

    digits = _digits(found)
    ssn = _refill(found, feistel(digits, LOWER[:10], "ssn", key), r"\D")
    # A phone number keeps its country code; the rest is permuted.
    code = F.regexp_extract(found, r"^(\+\d{1,3}[ .(-]|)", 1)
    rest = F.substring(found, F.length(code) + 1, F.length(found))
    phone = F.concat(code, _refill(rest, feistel(_digits(rest), LOWER[:10], "phone", key), r"\D"))

    body = feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), LOWER[:10], "card", key)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = _refill(found, F.concat(body, check), r"\D")

    plain = F.regexp_replace(found, " ", "")
    country, bban = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    numbers = feistel(_digits(bban), LOWER[:10], "iban", key)
    moved = F.when(F.length(_digits(bban)) > 0, _refill(bban, numbers, r"\D")).otherwise(bban)
    sum97 = F.lpad((98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    iban = _refill(found, F.lower(F.concat(country, sum97, moved)), " ")

    low = F.lower(F.regexp_replace(found, "[^A-Za-z0-9]", ""))
    secret = _refill(found, F.when(low.rlike("^[0-9a-f]+$"), feistel(low, LOWER[:16], "hex", key)).otherwise(
        feistel(low, LOWER, "secret", key)), "[^A-Za-z0-9]")

    pattern = F.when(found.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(found.contains("."), "dd.MM.yyyy").otherwise("dd/MM/yyyy")
    day = _day(_date(found), key)
    date = F.when(pattern == "yyyy-MM-dd", F.date_format(day, "yyyy-MM-dd")).when(
        pattern == "dd.MM.yyyy", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    made = F.lit(None).cast("string")
    for label, value in (("secret", secret), ("card", card), ("phone", phone), ("iban", iban), ("ssn", ssn), ("ip", ip), ("date", date), ("email", email)):
        made = F.when(kind == label, value).otherwise(made)
    return F.coalesce(made, found)


def pseudonymised(text: Column, key: str) -> tuple[Column, Column]:
    """(text with pseudonyms, kinds found in order). Most texts have no digit and no @ and are passed through."""
    suspect = text.rlike(r"[0-9@]|(?i:token|secret|passw|api.?key)")
    values = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    parts = F.transform(values, _parts)
    kinds = F.filter(F.transform(F.flatten(parts), lambda p: p["kind"]), lambda k: k.isNotNull())
    swapped = F.transform(parts, lambda own: F.array_join(F.transform(own, lambda p: _pseudonym(p["value"], p["kind"], key)), ""))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, swapped, lambda g, s: F.array(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit(""))))), "")
    none = F.array().cast("array<string>")
    return (F.when(suspect & (F.size(values) > 0), joined).otherwise(text),
            F.when(suspect, kinds).otherwise(none))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The table with ``text`` rewritten; every other column as it was."""
    return docs.withColumn(text, pseudonymised(F.col(text), key)[0])


def findings(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_found, kinds (in the order of the text)."""
    new, kinds = pseudonymised(F.col(text), key)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), new.alias("text"), kinds.alias("kinds")).select(
        "doc_id", "text", F.coalesce(F.size("kinds"), F.lit(0)).alias("n_found"), "kinds")
