"""Column expressions of the literal detector: matches with byte columns, validators, masks, hashes.

Everything is built from SQL functions. Word borders are spelled as ASCII
look-arounds, because ``\\b`` is Unicode-aware in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BEFORE, WORD_AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

#: Formats of the values.
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9\\-]{0,61}[A-Za-z0-9])?"
EMAIL = "[A-Za-z0-9][A-Za-z0-9._%+\\-]{0,63}@" + _LABEL + "(?:\\." + _LABEL + ")*\\.[A-Za-z]{2,24}" + WORD_AFTER
CARD = WORD_BEFORE + "[0-9](?:[ \\-]?[0-9]){12,18}" + WORD_AFTER
SSN = WORD_BEFORE + "([0-9]{3})-([0-9]{2})-([0-9]{4})" + WORD_AFTER
IBAN = WORD_BEFORE + "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?" + WORD_AFTER

MAX_LINE_BYTES, BINARY_PREFIX, MAX_FILE_BYTES = 4096, 8000, 2 << 20

#: Lists of the e-mail rule.
PLACEHOLDER_DOMAINS = (
    "example.com example.org example.net test.com domain.com email.com mycompany.com yourcompany.com company.com acme.com foo.com bar.com sample.com mail.com "
    "yourdomain.com users.noreply.github.com noreply.github.com localhost anthropic.com"
).split()
RESERVED_SUFFIXES = (".test", ".invalid", ".example", ".local", ".internal")
ROLE_LOCAL_PARTS = (
    "noreply no-reply donotreply do-not-reply support info admin contact hello sales security abuse postmaster webmaster privacy team dev devs git user test root "
    "john.doe jane.doe johndoe janedoe foo bar someone somebody name email your.email youremail username example help billing careers jobs press legal office hr "
    "marketing notifications notification alerts bot ci build release ops devops it mail noc opensource open-source oss conduct community maintainers feedback hi "
    "hey team-security psirt cert"
).split()
DEMO_ACCOUNTS = "test testuser tester testing dummy demo fake sample example foo bar foobar john.doe jane.doe johndoe janedoe".split()
FILE_TLDS = (
    "png jpg jpeg gif svg webp ico js ts tsx jsx css scss json xml kt java go py rb md txt html htm yaml yml lock zip gz tar pdf map vue class jar aar so dll exe"
).split()
COMMON_TLDS = (
    "com net org edu gov mil int info biz io co ai app dev me tv xyz online site tech store shop cloud email name pro asia mobi live life world today space website "
    "digital network solutions services agency company group global media news blog club design studio systems software academy school center health finance bank "
    "insurance vip work"
).split()
ATTRIBUTION_WORDS = "copyright author maintainer contributor signed-off-by co-authored-by license credits".split()
#: Published test cards, advertising numbers and documentation accounts.
TEST_CARDS = (
    "4111111111111111 4242424242424242 4012888888881881 4000056655665556 5555555555554444 5105105105105100 5200828282828210 378282246310005 371449635398431 "
    "6011111111111117 6011000990139424 3530111333300000 3566002020360505 30569309025904 38520000023237 4000000000000002 4000000000009995 4000000000000077 "
    "4000000000003220 2223003122003222 6200000000000005 5454545454545454 4917610000000000 4444333322221111 4000000000000010 4000002500003155 5200000000000007 "
    "4988438843884305"
).split()
AD_SSNS = ("078051120", "219099999", "123456789")
DOC_IBANS = "GB82WEST12345698765432 DE89370400440532013000 GB33BUKB20201555555555 FR1420041010050500013M02606 NL91ABNA0417164300".split()
PLACEHOLDER_MARKS = "EXAMPLE XXXX 0000000 1234567 ABCDEFG YOUR REPLACE DUMMY PLACEHOLDER REDACTED CHANGEME ${ {{ < *".split()
SAMPLE_TOKEN = "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
#: Prefix of value hashes.
HASH_PREFIX = "veilgrid-literal"


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def within_ascii(pattern: str) -> str:
    """A pattern with ``\\b`` spelled for ASCII words: every border of the given patterns faces a word character."""
    head = WORD_BEFORE + pattern[2:] if pattern.startswith("\\b") else pattern
    return head[:-2] + WORD_AFTER if head.endswith("\\b") else head


def matches(line: Column, pattern: str, group: int = 0) -> Column:
    """All matches as structs (value, start in characters, byte column from 1); ``group`` 1 must begin the match."""
    whole, parts = F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.split(line, pattern, -1)
    values = F.regexp_extract_all(line, F.lit(pattern), F.lit(group)) if group else whole
    held = F.struct(values.alias("v"), whole.alias("w"), parts.alias("p"))

    def size(upto: Column, measure) -> Column:
        add = lambda n: lambda acc, x: acc + measure(x)
        return F.aggregate(F.slice(held["p"], 1, upto + 1), F.lit(0), add(0)) + F.aggregate(F.slice(held["w"], 1, upto), F.lit(0), add(0))

    return F.transform(values, lambda v, i: F.struct(v.alias("value"), size(i, F.length).alias("start"), (size(i, F.octet_length) + 1).alias("col")))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def card_grouping(raw: Column) -> Column:
    """No separators; or one kind of separator and the groups that card numbers are written in."""
    lengths = lambda sep: F.transform(F.split(raw, sep), lambda g: F.length(g))
    last = "^[0-9]{4}(?:%s[0-9]{4})*%s[0-9]{1,4}$"
    one = [F.regexp(raw, F.lit(last % (s, s))) | (lengths(s) == F.array(F.lit(4), F.lit(6), F.lit(5))) | (lengths(s) == F.array(F.lit(4), F.lit(6), F.lit(4))) for s in (" ", "-")]
    return ~F.regexp(raw, F.lit("[ -]")) | _any(one)


def decimal_part(line: Column, start: Column, raw: Column) -> Column:
    """Whether a run of digits is the integer or fraction part of a decimal number."""
    before = (start >= 2) & F.regexp(F.substr(line, start - 1, F.lit(2)), F.lit("^[0-9][.]$"))
    after = F.regexp(F.substr(line, start + F.length(raw) + 1, F.lit(2)), F.lit("^[.][0-9]$"))
    return before | after


def trivial_digits(d: Column) -> Column:
    """Too short, or with a run, an ascending or descending run of six, or mostly zeros."""
    cyclic = lambda s: _any([F.contains(d, F.lit((s * 2)[k : k + 6])) for k in range(10)])
    zeros = F.length(d) - F.length(F.replace(d, F.lit("0")))
    return (F.length(d) < 6) | F.regexp(d, F.lit("([0-9])\\1{5}")) | cyclic("0123456789") | cyclic("9876543210") | (zeros * 10 >= F.length(d) * 7)


def card_confidence(d: Column) -> Column:
    """0 unless the digits pass the checksum and an issuer's range."""
    n, n2, n4 = F.length(d), F.substring(d, 1, 2).cast("int"), F.substring(d, 1, 4).cast("int")
    network = (
        F.when(F.startswith(d, F.lit("4")) & n.isin(13, 16, 19), 0.85)
        .when((n2.between(51, 55) | n4.between(2221, 2720)) & (n == 16), 0.85)
        .when(n2.isin(34, 37) & (n == 15), 0.85)
        .when(n4.between(3528, 3589) & (n >= 16), 0.85)
        .when((F.startswith(d, F.lit("6011")) | n2.isin(65, 62)) & (n >= 16), 0.8)
        .otherwise(0.0)
    )
    out = ~n.between(13, 19) | d.isin(TEST_CARDS) | trivial_digits(F.substr(d, F.lit(7))) | ~F.call_function("luhn_check", d)
    return F.when(out, 0.0).otherwise(network)


def valid_ssn(v: Column) -> Column:
    area, group, serial = (F.split_part(v, F.lit("-"), F.lit(k)) for k in (1, 2, 3))
    return ~(area.isin("000", "666") | F.startswith(area, F.lit("9")) | (group == "00") | (serial == "0000") | digits(v).isin(*AD_SSNS))


def valid_iban(v: Column) -> Column:
    """ISO 7064 mod 97 of an account number without blanks."""
    turned = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    step = lambda acc, c: F.when(F.regexp(c, F.lit("^[0-9]$")), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))
    return F.length(v).between(15, 34) & F.regexp(v, F.lit("^[0-9A-Z]+$")) & (rest == 1)


def email_confidence(v: Column, line: Column, start: Column, placeholder_domains: list[str] = PLACEHOLDER_DOMAINS) -> Column:
    """0, 0.5 or 0.8 for an address in its line."""
    raw_domain = F.substring_index(v, "@", -1)
    local, domain = F.lower(F.substring_index(v, "@", 1)), F.lower(raw_domain)
    tld = F.substring_index(domain, ".", -1)
    before = F.when(start > 0, F.substr(line, start, F.lit(1))).otherwise("")
    ends = lambda xs: _any([F.endswith(domain, F.lit(x)) for x in xs])
    out = (
        tld.isin(FILE_TLDS)
        | domain.isin(placeholder_domains)
        | ends([f".{d}" for d in placeholder_domains])
        | ends(RESERVED_SUFFIXES)
        | local.isin(ROLE_LOCAL_PARTS)
        | F.startswith(local, F.lit("noreply"))
        | F.startswith(local, F.lit("no-reply"))
        | F.regexp_replace(local, "[0-9._-]+$", "").isin(DEMO_ACCOUNTS)
        | before.isin("/", "@")
        | F.contains(local, F.lit("${"))
        | F.contains(local, F.lit("%s"))
        | local.isin("this", "super", "it")
        | F.regexp(raw_domain, F.lit("[a-z][A-Z]"))
        | _any([F.contains(F.lower(line), F.lit(w)) for w in ATTRIBUTION_WORDS])
    )
    return F.when(out, 0.0).when((F.length(tld) != 2) & ~tld.isin(COMMON_TLDS), 0.5).otherwise(0.8)


def entropy(v: Column) -> Column:
    """Shannon entropy in bits a byte of ASCII text."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def placeholder_secret(v: Column) -> Column:
    return F.contains(v, F.lit(SAMPLE_TOKEN)) | _any([F.contains(F.upper(v), F.lit(w)) for w in PLACEHOLDER_MARKS])


def mask_value(data_type: Column, v: Column) -> Column:
    """A rendering that is safe for reports."""
    at = F.length(v) - F.length(F.substring_index(v, "@", -1))  # place of the last @
    mail = F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(3), at - 2)), F.substr(v, at))
    n, tail_only = F.length(v), data_type.isin("credit_card", "bank_account")
    tail = F.concat(F.repeat(F.lit("*"), n - 4), F.right(v, F.lit(4)))
    rest = F.concat(F.substring(v, 1, 3), F.repeat(F.lit("*"), n - 5), F.right(v, F.lit(2)))
    other = F.when(n <= 6, F.repeat(F.lit("*"), n)).when(tail_only, tail).otherwise(rest)
    return F.when(data_type == "email", F.when(at <= 1, F.lit("***")).otherwise(mail)).otherwise(other)


def mask_secret(v: Column) -> Column:
    """The first four characters, which name a secret's kind, and nothing of the secret."""
    return F.when(F.length(v) <= 8, "********").otherwise(F.concat(F.substring(v, 1, 4), F.lit("********")))


def digest(*parts: Column) -> Column:
    """24 hex digits that identify the NUL-joined parts."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24)


def value_hash(data_type: Column, v: Column) -> Column:
    return digest(F.lit(HASH_PREFIX), data_type, F.lower(v))


def rounded(confidence: Column) -> Column:
    """At most 1, two decimals, half up."""
    return F.floor(F.least(confidence, F.lit(1.0)) * 100 + 0.5) / 100
