"""Operator 10: private data replaced by format-preserving Feistel pseudonyms.

Payment-card numbers (Luhn-valid), US social-security numbers, telephone numbers, IPv4 and IPv6 addresses, calendar dates,
e-mail addresses, access keys, hexadecimal secrets and values that a name like `password=` gives away are found, validated,
and permuted by a keyed Feistel network within their own format: the pseudonym of a card is Luhn-valid and keeps its
spacing, that of a date is a date. A permutation keeps equal values equal in all documents, however they are spaced, and
different ones apart. What does not validate stays as it is. All of it is column expressions; only texts with a digit or
one of @ = : are searched. Every pattern is linear: runs of any length are taken without recursion or a second look.

Whoever has the key can undo the pseudonyms. It is read from `spark.cosmolith.pii.key` or COSMOLITH_PII_KEY; where neither
is set, a random one holds for the life of the driver, so that pseudonyms of two runs are not linked. What stands in the
plan, and so in explain(), the UI and event logs, is a subkey derived from it: it undoes these pseudonyms, but does not
tell the key. Set spark.sql.redaction.string.regex to the pattern SUBKEY to keep it out of those, too.

A value after a name and `=`, a quote or a bare `:` is taken whatever it is, from six characters on; after `: ` only if it has
a digit, as prose has such words.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.llm.common import table

KEY_SETTING, KEY_VARIABLE = "spark.cosmolith.pii.key", "COSMOLITH_PII_KEY"
_OWN_KEY = secrets.token_hex(32)
SUBKEY = "subkey-[0-9a-f]{64}"
ROUNDS = 8
#: Days since 0001-01-01 at which an era starts, and two factors of its number of days: to 1899, to 2099, to 9999. A date
#: stays in its era.
ERAS = ((0, (245, 2831)), (693_595, (319, 229)), (766_644, (195, 14_797)))
FIRST_DAY, LAST_DAY = "0001-01-01", 3_652_058

#: What is looked for, in this order at any place.
PATTERNS = {
    "named": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)(?:[ ]{0,3}=[ ]{0,3}[\x22\x27]?|:[\x22\x27]?|[ ]{0,3}:[ ]{0,3}[\x22\x27]|[ ]{1,3}:|[ ]{0,3}:[ ]{1,3}(?=[^\x20\x09-\x0D\x22\x27]*?[0-9]))[^\x20\x09-\x0D\x22\x27]{6,}+",
    "email": r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "access": r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk|ghp|gho|ghs|xoxb|xoxp)[_-][0-9A-Za-z_-]{16,}+)(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "abroad": r"(?<![0-9A-Za-z+])\+[2-9](?:[ .()-]{0,2}[0-9]){8,13}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}(?:-[0-9]{2}-| [0-9]{2} )[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,38}?[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: The kinds that are counted; named values and access keys count as secrets.
KINDS = {k: [k] if k != "secret" else ["named", "access", "secret"] for k in PATTERNS if k not in ("named", "access")}
ALPHABETS = {"digit": "0123456789", "hex": "0123456789abcdef", "a-f": "abcdef", "A-F": "ABCDEF", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key_of(spark: SparkSession) -> str:
    return subkey(spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE) or _OWN_KEY)


def subkey(key: str) -> str:
    """The key that enters plans: derived by a keyed hash, equal for equal keys, marked so that it can be redacted."""
    return "subkey-" + hmac.new(key.encode(), b"format-preserving pseudonyms", hashlib.sha256).hexdigest()


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _hash(key: str, kind, turn: Column, other: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), _lit(kind), turn.cast("string"), other.cast("string")).cast("binary"), 512)


def feistel_pair(key: str, kind, a: Column, b: Column, sizes: tuple) -> Column:
    """struct(a, b) of a permutation of Z_m x Z_n: in turn a part gets a keyed hash of the other added. kind and sizes may be columns."""
    number = lambda turn, other: F.conv(F.substring(_hash(key, kind, turn, other), 1, 13), 16, 10).cast("long")

    def step(acc: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        moved = _bound(number(turn, F.when(even, acc["b"]).otherwise(acc["a"])), lambda n: F.struct(
            F.when(even, F.pmod(acc["a"] + n, _lit(sizes[0]))).otherwise(acc["a"]).cast("long").alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + n, _lit(sizes[1]))).cast("long").alias("b")))
        return moved

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def feistel_text(key: str, kind, text: Column, alphabets: list) -> Column:
    """A permutation of the texts of one layout, of any length: each character moves within its alphabet.

    alphabets are names of ALPHABETS, or such names with the condition under which one holds. 64 characters of a half are
    moved by one hash of the other half; further ones by hashes of that hash and their block.
    """
    named = [(x, None) if isinstance(x, str) else x for x in alphabets]

    def moved(part: Column, other: Column, turn: Column) -> Column:
        def with_blocks(blocks: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                by = F.conv(F.substr(F.get(blocks, F.floor(i / 64).cast("int")), 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")
                out = c
                for name, on in named:
                    letters = F.lit(ALPHABETS[name])
                    at = F.call_function("instr", letters, c)
                    new = F.substr(letters, F.pmod(at - 1 + by, F.lit(len(ALPHABETS[name]))).cast("int") + 1, F.lit(1))
                    out = F.when(at > 0 if on is None else on & (at > 0), new).otherwise(out)
                return out

            return F.transform(part, char)

        last = F.floor((F.greatest(F.size(part), F.lit(1)) - 1) / 64).cast("int")
        more = lambda h: F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k == 0, h).otherwise(F.sha2(F.concat_ws("|", h, k.cast("string")).cast("binary"), 512)))
        return _bound(_hash(key, kind, turn, F.array_join(other, "")), lambda h: _bound(more(h), with_blocks))

    def step(acc: Column, turn: Column) -> Column:  # the halves change places each turn
        return F.struct(acc["b"].alias("a"), moved(acc["a"], acc["b"], turn).alias("b"))

    def halves(chars: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars) - half).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.array_join(F.concat(acc["a"], acc["b"]), ""))

    return _bound(F.filter(F.split(text, ""), lambda c: c != ""), halves)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(body: Column) -> Column:
    """Of the digits before the check digit: the last counts double, and so on."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(body, F.length(body) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add)


def _check_digit(body: Column) -> Column:
    return F.pmod(10 - _luhn_sum(body) % 10, F.lit(10)).cast("string")


def _laid_out(like: Column, digits: Column) -> Column:
    """digits in the places of like's digits."""
    def placed(own: Column) -> Column:
        def char(i: Column) -> Column:
            c = F.substr(like, i, F.lit(1))
            return F.when(c.rlike("[0-9]"), F.substr(own, F.length(_digits(F.substr(like, F.lit(1), i))), F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), char), "")

    return _bound(digits, placed)


def _day(m: Column) -> Column:
    """Days since FIRST_DAY of a date in either layout; null if there is no such day."""
    iso = F.when(F.substr(m, F.lit(3), F.lit(1)) == "/", F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2)))).otherwise(m)
    return F.date_diff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))


def _phone(m: Column) -> Column:
    """The ten national digits."""
    ds = _digits(m)
    return F.when(m.startswith("+1"), F.substr(ds, F.lit(2), F.lit(10))).otherwise(ds)


def _valid(m: Column) -> dict[str, Column]:
    """Whether a match of each kind validates. Telephone numbers without +1 or brackets need an area and an exchange from 200 on."""
    ds = _digits(m)
    part = lambda x, at, n: F.substr(x, F.lit(at), F.lit(n)).try_cast("int")
    always = F.lit(True)
    day = _day(m)
    found = {
        "named": always, "access": always, "secret": always, "abroad": always, "ip6": always,
        "email": m.rlike(r"@.*\.[A-Za-z]{2}"),
        "phone": m.startswith("+1") | m.startswith("(") | (part(ds, 1, 3) >= 200) & (part(ds, 4, 3) >= 200),
        "ssn": (part(ds, 1, 3) != 0) & (part(ds, 1, 3) != 666) & (part(ds, 1, 3) < 900) & (part(ds, 4, 2) != 0) & (part(ds, 6, 4) != 0),
        "date": (day >= 0) & (day <= LAST_DAY),
        "ip": ~F.exists(F.split(m, r"\."), lambda x: x.try_cast("int") > 255),
        "card": F.substr(ds, F.length(ds), F.lit(1)) == _check_digit(F.substr(ds, F.lit(1), F.length(ds) - 1)),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def kind_of(m: Column) -> Column:
    """The kind of a match; null if it does not validate."""
    valid, kind = _valid(m), F.when(F.lit(False), F.lit(""))
    for name, pattern in PATTERNS.items():
        kind = kind.when(m.rlike(f"^(?:{pattern})$"), F.when(valid[name], F.lit(name)))
    return kind


def _numbered(key: str, kind: Column, m: Column) -> Column:
    """The pseudonym of a telephone number, social-security number, date or IPv4 address: its rank among all such values is permuted."""
    part = lambda x, at, n: F.substr(x, F.lit(at), F.lit(n)).try_cast("long")

    def of(ds: Column, day: Column) -> Column:
        area, exchange, line = part(ds, 1, 3), part(ds, 4, 3), part(ds, 7, 4)
        usual = (area >= 200) & (exchange >= 200)  # 800 areas by 800 exchanges; other numbers move among themselves
        odd = F.when(area < 200, area * 10_000_000 + exchange * 10_000 + line).otherwise(2_000_000_000 + ((area - 200) * 200 + exchange) * 10_000 + line)
        group, serial = part(ds, 4, 2), part(ds, 6, 4)  # 898 areas (001-899 without 666), groups 01-99, serials 0001-9999
        octets = F.split(m, r"\.")
        is_phone, is_ssn, is_date = kind == "phone", kind == "ssn", kind == "date"
        era = lambda pick: F.when(day >= ERAS[2][0], pick(ERAS[2])).when(day >= ERAS[1][0], pick(ERAS[1])).otherwise(pick(ERAS[0]))
        rank = (
            F.when(is_phone, F.when(usual, ((area - 200) * 800 + exchange - 200) * 10_000 + line).otherwise(odd))
            .when(is_ssn, (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1)
            .when(is_date, day - era(lambda e: F.lit(e[0])))
            .otherwise(F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.try_cast("long")))
        )
        size = lambda i: F.when(is_phone, F.when(usual, 80_000).otherwise(60_000)).when(is_ssn, (898, 99 * 9999)[i]).when(is_date, era(lambda e: F.lit(e[1][i]))).otherwise(65_536).cast("long")
        label = F.when(is_phone & ~usual, "odd phone").when(is_date, F.concat(F.lit("date"), era(lambda e: F.lit(str(e[0]))))).otherwise(kind)

        def back(n: Column) -> Column:
            digits = lambda form, *x: F.format_string(form, *(v.cast("long") for v in x))
            rest = n - 2_000_000_000
            phone = F.when(usual, digits("%03d%03d%04d", F.floor(n / 8_000_000) + 200, F.floor(n / 10_000) % 800 + 200, n % 10_000)).when(
                n < 2_000_000_000, digits("%03d%03d%04d", F.floor(n / 10_000_000), F.floor(n / 10_000) % 1000, n % 10_000)
            ).otherwise(digits("%03d%03d%04d", F.floor(rest / 2_000_000) + 200, F.floor(rest / 10_000) % 200, n % 10_000))
            place = F.floor(n / (99 * 9999))
            ssn = digits("%03d%02d%04d", F.when(place >= 665, place + 2).otherwise(place + 1), F.floor(n / 9999) % 99 + 1, n % 9999 + 1)
            date = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (n + era(lambda e: F.lit(e[0]))).cast("int")), "yyyyMMdd")
            date = F.when(F.substr(m, F.lit(3), F.lit(1)) == "/", F.concat(F.substr(date, F.lit(5), F.lit(4)), F.substr(date, F.lit(1), F.lit(4)))).otherwise(date)
            ip = F.concat_ws(".", *((F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)))
            lead = F.when(is_phone & m.startswith("+1"), F.lit("1")).otherwise(F.lit(""))
            return F.when(kind == "ip", ip).otherwise(_laid_out(m, F.concat(lead, F.when(is_phone, phone).when(is_ssn, ssn).otherwise(date))))

        second = size(1)
        moved = lambda r: feistel_pair(key, label, F.floor(r / second), r % second, (size(0), second))
        return _bound(_bound(_bound(rank, moved), lambda p: p["a"] * second + p["b"]), back)

    return _bound(F.when(kind == "phone", _phone(m)).otherwise(_digits(m)), lambda ds: _bound(_day(m), lambda day: of(ds, day)))


def _lettered(key: str, kind: Column, m: Column) -> Column:
    """The pseudonym of all else: its characters move in place.

    An access key keeps its prefix, a number from abroad its first two digits, an e-mail address its last label, a name
    like `password=` stands. A hexadecimal value in one case shares its pseudonym with its other-case twin.
    """
    is_named, is_email, is_card, is_abroad, is_ip6 = (kind == k for k in ("named", "email", "card", "abroad", "ip6"))
    lead = F.when(is_named, F.length(F.regexp_extract(m, r"^[^=:]*[=:][ ]*[\x22\x27]?", 0))).otherwise(0)
    value = F.when(is_named, F.regexp_replace(F.substr(m, lead + 1, F.length(m)), r"(?<![.,;:!?)])[.,;:!?)]++$", "")).otherwise(m)

    def of(v: Column) -> Column:
        ds, at = _digits(m), F.call_function("instr", m, F.lit("@"))
        secret = is_named | (kind == "access") | (kind == "secret")
        access, lower, upper, both = (secret & v.rlike(p) for p in (f"^(?:{PATTERNS['access']})$", "^[0-9a-f]+$", "^[0-9A-F]+$", "^[0-9A-Fa-f]+$"))
        mark = F.when(access, F.when(v.rlike("^A[KS]IA"), 4).otherwise(F.length(F.regexp_extract(v, "^[a-z]+[_-]", 0)))).otherwise(0)
        body = (
            F.when(is_email, F.substr(m, F.lit(1), at - 1)).when(is_card, F.substr(ds, F.lit(1), F.length(ds) - 1)).when(is_abroad, F.substr(ds, F.lit(3), F.length(ds)))
            .when(upper & ~lower, F.lower(v)).otherwise(F.substr(v, mark + 1, F.length(v)))
        )
        mode = F.when(lower | upper, 1).when(both | is_ip6, 2).when(is_card | is_abroad, 3).otherwise(4)
        label = F.when(access, F.lit("access")).when(secret, F.lit("secret")).otherwise(kind)

        def back(x: Column) -> Column:
            last = F.substring_index(m, ".", -1)
            name = F.substr(m, at + 1, F.length(m) - at - F.length(last) - 1)
            email = F.concat(x, F.lit("@"), feistel_text(key, "domain", name, ["digit", "lower", "upper"]), F.lit("."), last)
            layout = F.when(is_card, F.concat(x, _check_digit(x))).otherwise(F.concat(F.substr(ds, F.lit(1), F.lit(2)), x))
            whole = F.concat(F.substr(m, F.lit(1), lead), F.substr(v, F.lit(1), mark), F.when(upper & ~lower, F.upper(x)).otherwise(x), F.substr(m, lead + F.length(v) + 1, F.length(m)))
            return F.when(is_email, email).when(is_card | is_abroad, _laid_out(m, layout)).otherwise(whole)

        def moved(how: Column) -> Column:  # of what is worked out once, so that nothing is asked of the whole value for each character
            n, c = how["mode"], how["label"]
            return feistel_text(key, c, how["body"], [("hex", n == 1), ("digit", n > 1), ("a-f", n == 2), ("A-F", n == 2), ("lower", n == 4), ("upper", n == 4)])

        return _bound(_bound(F.struct(mode.alias("mode"), label.alias("label"), body.alias("body")), moved), back)

    return _bound(value, of)


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    """What stands for a match of a kind; the match itself if the kind is null."""
    return F.when(kind.isNull(), m).when(kind.isin("phone", "ssn", "date", "ip"), _numbered(key, kind, m)).otherwise(_lettered(key, kind, m))


def pseudonymise(docs: DataFrame, keep: list[str], key: str | None = None) -> DataFrame:
    """`keep` with text, its private data replaced, and n_<kind> for each of KINDS. key: as in the setting (see key_of).

    A null text stays null with counts of 0; rows are treated one by one, so repeated rows give repeated results and an
    empty table an empty one; columns in `keep` that clash with these are replaced. Texts and values may be of any length.
    Dates are yyyy-mm-dd and mm/dd/yyyy; IPv6 groups that hold no decimal digit at all are taken for words.
    """
    key = key_of(docs.sparkSession) if key is None else subkey(key)
    counts = {f"n_{k}" for k in KINDS}
    keep = [c for c in keep if c not in counts and c != "text"]
    any_of = "|".join(PATTERNS.values())
    may = F.coalesce(F.col("text").rlike("[0-9@=:]"), F.lit(False))
    nothing = F.array().cast("array<string>")
    found = docs.select(*keep, "text").withColumn("_m", F.when(may, F.regexp_extract_all("text", F.lit(any_of), F.lit(0))).otherwise(nothing))

    def told(m: Column) -> Column:
        return _bound(kind_of(m), lambda kind: F.struct(kind.alias("kind"), pseudonym(key, kind, m).alias("value")))

    found = found.withColumn("_p", F.when(F.size("_m") > 0, F.transform("_m", told)).otherwise(F.array().cast("array<struct<kind: string, value: string>>")))
    parts = F.zip_with(F.split("text", any_of), F.col("_p"), lambda s, p: F.concat(s, F.coalesce(p["value"], F.lit(""))))
    text = F.when(F.size("_p") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    number = lambda k: F.size(F.filter("_p", lambda p: F.coalesce(p["kind"].isin(KINDS[k]), F.lit(False)))).alias(f"n_{k}")
    return found.select(*keep, text.alias("text"), *(number(k) for k in KINDS))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with its texts replaced, and n_chars, where there is one, kept true: an address may change in length."""
    rows = docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    out, kinds = pseudonymise(rows, ["_row"]), dict(docs.dtypes)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNull(), F.col("_row")["n_chars"] if "n_chars" in kinds else None).otherwise(F.length("text")).cast(kinds.get("n_chars", "long"))}
    return out.select(*(new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns))
