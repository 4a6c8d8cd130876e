"""Personal data replaced by format-preserving pseudonyms, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import unused

#: Rounds of the keyed permutation.
ROUNDS = 10
#: For demonstrations: pseudonyms under a published key can be undone by anyone. KEY_SETTING names the session's own.
KEY = "riskweave-demonstration-key"
KEY_SETTING = "spark.riskweave.pseudonym.key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
_DATE = r"(?<![\d/.-])(?:(?:1[7-9]|20)\d\d-\d\d-\d\d|\d{1,2}/\d{1,2}/(?:1[7-9]|20)\d\d|\d{1,2}\.\d{1,2}\.(?:1[7-9]|20)\d\d)(?![\d/-]|\.\d)"
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])"
_CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{4,5})(?!\d)"
NUMBER = "|".join((_IBAN, _DATE, _IP, _PHONE, _SSN, _CARD))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(left: str, right: str, a: str, b: str, kind: str, key: str) -> str:
    """struct(l, r): a keyed permutation of the pairs below a and b. Even rounds shift l by a hash of r, odd ones r by one of l."""
    salt = _text(f"{key}|{kind}|")

    def shift(of: str) -> str:
        return f"cast(conv(substr(sha2(concat({salt}, {a}, '|', i, '|', {of}), 256), 1, 15), 16, 10) as bigint)"

    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), struct(cast({left} as bigint) as l, cast({right} as bigint) as r), (s, i) -> "
        f"if(i % 2 = 0, struct((s.l + {shift('s.r')}) % {a} as l, s.r as r), struct(s.l as l, (s.r + {shift('s.l')}) % {b} as r)))"
    )


def _let(value: str, name: str, body: str) -> str:
    """body with value under a name, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(d: str, kind: str, key: str) -> str:
    """A digit string of 2 to 30 digits, permuted among those of its length."""
    half = f"(length({d}) div 2)"
    power_l, power_r = (f"cast(rpad('1', 1 + {n}, '0') as bigint)" for n in (half, f"length({d}) - {half}"))
    moved = _feistel(f"substr({d}, 1, {half})", f"substr({d}, 1 + {half})", power_l, power_r, kind, key)
    return _let(moved, "m", f"concat(lpad(cast(m.l as string), {half}, '0'), lpad(cast(m.r as string), length({d}) - {half}, '0'))")


def _luhn(d: str, first_doubled: int) -> str:
    """Sum of Luhn's digits; first_doubled: 0 if the last digit counts double."""
    return (
        f"aggregate(transform(split(reverse({d}), ''), (c, k) -> if(c = '', 0, if(k % 2 = {first_doubled}, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int)))), 0, (s, c) -> s + c)"
    )


def _into(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    return (
        f"aggregate(split({shape}, ''), struct('' as o, 1 as k), (s, c) -> "
        f"if(c rlike '^[0-9]$', struct(concat(s.o, substr({digits}, s.k, 1)) as o, s.k + 1 as k), struct(concat(s.o, c) as o, s.k as k)), s -> s.o)"
    )


_ONLY = "regexp_replace({0}, '[^0-9]', '')"


def _card(h: str, key: str) -> str:
    payload = _digits("p", "card", key)
    checked = _let(payload, "q", f"concat(q, cast((10 - {_luhn('q', 0)} % 10) % 10 as string))")
    return _let(f"substr(d, 1, length(d) - 1)", "p", _let(checked, "n", _into(h, "n")))


def _phone(h: str, key: str) -> str:
    moved = _let("right(d, 10)", "p", _digits("p", "phone", key))
    return _let(f"concat(left(d, length(d) - 10), {moved})", "n", _into(h, "n"))


def _ssn(h: str, key: str) -> str:
    area = "(cast(substr(d, 1, 3) as int) - if(cast(substr(d, 1, 3) as int) > 666, 2, 1))"
    moved = _feistel(f"{area} * 99 + cast(substr(d, 4, 2) as int) - 1", "cast(substr(d, 6) as int) - 1", "88902", "9999", "ssn", key)
    number = "m.l div 99 + if(m.l div 99 >= 665, 2, 1)"
    return _let(moved, "m", f"concat(lpad(cast({number} as string), 3, '0'), '-', lpad(cast(m.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(m.r + 1 as string), 4, '0'))")


def _ip(h: str, key: str) -> str:
    part = [f"cast(element_at(split({h}, '[.]'), {k}) as int)" for k in (1, 2, 3, 4)]
    moved = _feistel(f"{part[0]} * 256 + {part[1]}", f"{part[2]} * 256 + {part[3]}", "65536", "65536", "ip", key)
    return _let(moved, "m", "concat_ws('.', m.l div 256, m.l % 256, m.r div 256, m.r % 256)")


_DAYS_OF = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Dates are those of 400 years; which day of the year and which year are permuted together. 29 February has its leap years.
_FIRST_YEAR, _YEARS, _LEAP_YEARS = 1700, 400, 97


def _days(months: int, first: int, last: int) -> list[int]:
    """Month and day, as in 1231, of the days from first to last of so many months, 29 February apart."""
    return [100 * m + d for m in range(1, months + 1) for d in range(first, min(last, _DAYS_OF[m - 1]) + 1)]


def _moved_date(days: list[int], code: str, year: str, kind: str, shown, key: str) -> str:
    """shown(code, year) of the date that takes this one's place among those days of all years; null if it isn't one of them."""
    among = f"array({', '.join(map(str, days))})"
    plain = _let(_feistel(f"{year} - {_FIRST_YEAR}", f"array_position({among}, {code}) - 1", str(_YEARS), str(len(days)), kind, key), "m", shown(f"element_at({among}, cast(m.r as int) + 1)", f"({_FIRST_YEAR} + m.l)"))
    nth = f"(({year} - 1704) div 4 - if({year} > 1800, 1, 0) - if({year} > 1900, 1, 0))"
    back = "(1704 + 4 * (m.l + if(m.l >= 24, 1, 0) + if(m.l >= 48, 1, 0)))"
    leap = _let(_feistel(nth, "0", str(_LEAP_YEARS), "1", f"{kind}-leap", key), "m", shown("229", back))
    is_leap = f"({year} % 4 = 0 and ({year} % 100 <> 0 or {year} % 400 = 0))"
    return f"case when array_position({among}, {code}) > 0 then {plain} when {code} = 229 and {is_leap} and array_contains({among}, 228) then {leap} end"


def _date(h: str, key: str) -> str:
    """The date moved within the 400 years among those written alike; null if it is none. Parts keep their numbers of digits;
    day before month where both are possible, so month before day only with days above 12."""
    iso = _moved_date(_days(12, 1, 31), "(v[1] * 100 + v[2])", "v[0]", "date", lambda code, year: f"concat(cast({year} as string), '-', lpad(cast({code} div 100 as string), 2, '0'), '-', lpad(cast({code} % 100 as string), 2, '0'))", key)
    cases = [f"when {h} like '%-%' then {iso}"]
    for a in (1, 2):
        for b in (1, 2):
            part = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"
            mark = f"substr({h}, {a + 1}, 1)"
            days = _moved_date(_days(12 if b == 2 else 9, 1, 31 if a == 2 else 9), "(v[1] * 100 + v[0])", "v[2]", f"date-{a}{b}", lambda c, y, a=a, b=b: f"concat({part(f'{c} % 100', a)}, {mark}, {part(f'{c} div 100', b)}, {mark}, cast({y} as string))", key)
            if b == 2:
                late = [x for x in _days(12 if a == 2 else 9, 13, 31)]
                months = _moved_date(late, "(v[0] * 100 + v[1])", "v[2]", f"date-m{a}", lambda c, y, a=a, b=b: f"concat({part(f'{c} div 100', a)}, {mark}, {part(f'{c} % 100', b)}, {mark}, cast({y} as string))", key)
                days = f"coalesce({days}, if({h} like '%/%', {months}, null))"
            cases.append(f"when {h} rlike '^[0-9]{{{a}}}[/.][0-9]{{{b}}}[/.]' then {days}")
    return _let(f"transform(split({h}, '[-/.]'), x -> cast(x as int))", "v", f"case {' '.join(cases)} end")


_VALUES = "aggregate(split({0}, ''), 0, (s, c) -> if(c = '', s, if(c rlike '^[0-9]$', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97)))"


def _iban(h: str, key: str) -> str:
    inner = _let("regexp_replace(substr(w, 5), '[^0-9]', '')", "p", _digits("p", "iban", key))
    body = _let(inner, "q", _into("substr(w, 5)", "q"))
    full = _let(body, "y", f"concat(left(w, 2), lpad(cast(98 - {_VALUES.format('concat(y, left(w, 2), ' + chr(39) + '00' + chr(39) + ')')} as string), 2, '0'), y)")
    spaced = f"if({h} like '% %', rtrim(regexp_replace(z, '(.{{4}})', '$1 ')), z)"
    return _let(full, "z", spaced)


def _pseudonym(h: str, key: str) -> str:
    """A found number's pseudonym, or the number itself if it isn't valid."""
    octets = f"forall(split({h}, '[.]'), o -> cast(o as int) < 256)"
    ssn_ok = "substr(d, 1, 3) not in ('000', '666') and left(d, 1) <> '9' and substr(d, 4, 2) <> '00' and substr(d, 6) <> '0000'"
    iban_ok = f"length(w) between 15 and 34 and length(regexp_replace(substr(w, 5), '[^0-9]', '')) between 2 and 30 and {_VALUES.format('concat(substr(w, 5), left(w, 4))')} = 1"
    cases = [
        (f"{h} rlike '^[A-Z]'", _let(f"replace({h}, ' ', '')", "w", f"if({iban_ok}, {_iban(h, key)}, {h})")),
        (f"{h} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$'", f"if({octets}, {_ip(h, key)}, {h})"),
        (f"length({h}) <= 10 and ({h} rlike '^[0-9]{{4}}-[0-9]{{2}}-' or {h} rlike '^[0-9]{{1,2}}[/.]')", f"coalesce({_date(h, key)}, {h})"),
        (f"{h} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'", f"if({ssn_ok}, {_ssn(h, key)}, {h})"),
        (f"{h} rlike '^[+(]' or {h} rlike '^[0-9]{{3}}[.-]'", _phone(h, key)),
        (f"{_luhn('d', 1)} % 10 = 0 and d rlike '[1-9]'", _card(h, key)),
    ]
    return _let(_ONLY.format(h), "d", "case " + " ".join(f"when {test} then {then}" for test, then in cases) + f" else {h} end")


def _email(h: str, key: str) -> str:
    return f"concat('user-', left(sha2(concat({_text(key + '|email|')}, lower({h})), 256), 20), '@example.invalid')"


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text", count_col: str = "n_pseudonyms") -> DataFrame:
    """docs with pseudonyms for personal data in text_col, and how many in count_col.

    Replaced are card numbers that pass Luhn's check, telephone numbers, IPv4 addresses, US social security numbers, IBANs
    with right check digits, dates that exist (1700 to 2099), and e-mail addresses. A number or date is moved by a keyed
    Feistel permutation among those of its format: length, separators, country code and check digits stay right, and
    distinct values stay distinct; dates are permuted among those written alike. Equal values get equal pseudonyms in all documents, in whatever grouping cards come.
    E-mail addresses have no finite format; they get a keyed hash at a reserved domain. What isn't valid stays as it is.
    Telephone numbers are told by their format alone: what looks like one is personal even where no numbering plan has it.
    Longer runs of digits than a format has stay. A number that fits several formats is the first of IBAN, date, IPv4,
    telephone, social security, card. The key is the argument, else the session's KEY_SETTING, else the published KEY.
    Null and empty texts stay; rows, order and all other columns are untouched, whatever their names. There is no shuffle.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    text = F.col(f"`{text_col}`")
    step = docs
    names: list[str] = []
    for name in ("mail", "mail_new", "mail_n", "number", "number_new", "number_n"):
        name = f"__{name}"
        while name in (*docs.columns, text_col, count_col, *names):
            name += "_"
        names.append(name)
    rules = ((names[:3], EMAIL, lambda h: _email(h, key), F.contains(text, F.lit("@"))), (names[3:], NUMBER, lambda h: _pseudonym(h, key), text.rlike(r"\d\d|\d\.\d")))
    for (name, new, changes), pattern, rule, there in rules:
        quoted = _text(pattern)
        found = F.when(there, F.expr(f"regexp_extract_all(`{text_col}`, {quoted}, 0)"))
        step = step.withColumn(name, F.when(F.size(found) > 0, found))
        step = step.withColumn(new, F.expr(f"transform(`{name}`, h -> {rule('h')})"))
        joined = F.expr(f"array_join(zip_with(split(`{text_col}`, {quoted}, -1), `{new}`, (p, h) -> concat(p, coalesce(h, ''))), '')")
        step = step.withColumn(text_col, F.when(F.col(name).isNotNull(), joined).otherwise(text))
        changed = F.expr(f"coalesce(size(filter(zip_with(`{name}`, `{new}`, (a, b) -> a <> b), x -> x)), 0)")
        step = step.withColumn(changes, changed).drop(name, new)
    return step.withColumn(count_col, (F.col(names[2]) + F.col(names[5])).cast("int")).drop(names[2], names[5])


def pseudonym_texts(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_pseudonyms), one row per document."""
    return pseudonymise(docs.select("doc_id", "text"), key)


def without_personal_data(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with pseudonyms in their texts; n_chars, where there is one, follows a changed text."""
    count = unused(docs, "__pseudonyms")
    out = pseudonymise(docs, key, count_col=count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
