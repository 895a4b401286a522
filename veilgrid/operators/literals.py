"""Literal detection: text lines to sensitive values found verbatim.

One lazy plan without user-defined functions: lines, a union of detectors, overlap
suppression inside a line, labels, file rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import detect as D
from veilgrid.functions import taxonomy
from veilgrid.operators import names

SHAPE = ["line", "col", "data_type", "masked", "value_hash", "confidence", "detector"]


def lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Numbered lines (from 1) beside all columns but the text: ``line``, ``content``, ``n_bytes``.

    A text that ends with a line feed has no last empty line.
    """
    kept = [c for c in df.columns if c != text_col]
    parts = F.split(F.col(text_col), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = df.select(*kept, F.posexplode(parts).alias("at_", "content"))
    return out.select(*kept, (F.col("at_") + 1).cast("long").alias("line"), "content", F.octet_length("content").cast("long").alias("n_bytes"))


def readable(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts that are not binary and within the size limit."""
    size = F.octet_length(text_col)
    return df.filter((size > 0) & (size <= D.MAX_FILE_BYTES) & ~F.contains(F.substring(text_col, 1, D.BINARY_PREFIX), F.lit("\0")))


def candidate_lines(df: DataFrame, text_col: str = "text", needs: str = "[0-9@]") -> DataFrame:
    """Lines short enough to scan that hold any of the needed characters."""
    return lines(df, text_col).filter((F.col("n_bytes") <= D.MAX_LINE_BYTES) & F.col("content").rlike(needs))


def card_candidates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Digit runs that could be card numbers, with their digits and grouping."""
    found = candidate_lines(df, text_col, "[0-9]").withColumn("m", F.explode(D.matches(F.col("content"), D.CARD)))
    return found.withColumns({"raw": F.col("m.value"), "digits": D.digits(F.col("m.value")), "grouped": D.card_grouping(F.col("m.value"))})


def card_findings(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Validated card numbers only, without labels: col, masked, value_hash, confidence."""
    found = card_candidates(df, text_col).filter(F.col("grouped") & ~D.decimal_part(F.col("content"), F.col("m.start"), F.col("raw")))
    found = found.withColumn("confidence", D.card_confidence(F.col("digits"))).filter(F.col("confidence") > 0)
    t = F.lit("credit_card")
    return found.select(
        *(c for c in df.columns if c != text_col), "line", F.col("m.col").cast("long").alias("col"), t.alias("data_type"), D.mask_value(t, F.col("digits")).alias("masked"),
        D.value_hash(t, F.col("digits")).alias("value_hash"), D.rounded(F.col("confidence")).alias("confidence"), F.lit("luhn+iin").alias("detector"),
    )


def email_candidates(df: DataFrame, text_col: str = "text", placeholder_domains: list[str] = D.PLACEHOLDER_DOMAINS) -> DataFrame:
    """All strings of an address's form with the confidence of the e-mail rule."""
    found = candidate_lines(df, text_col, "@").withColumn("m", F.explode(D.matches(F.col("content"), D.EMAIL)))
    return found.withColumns({"address": F.col("m.value"), "confidence": D.email_confidence(F.col("m.value"), F.col("content"), F.col("m.start"), placeholder_domains)})


def _finding(data_type: str, m: Column, confidence: Column, detector: str) -> Column:
    t = F.lit(data_type)
    return F.struct(
        m["col"].cast("long").alias("col"), t.alias("data_type"), D.mask_value(t, m["value"]).alias("masked"), D.value_hash(t, m["value"]).alias("value_hash"),
        confidence.cast("double").alias("confidence"), F.lit(detector).alias("detector"), m["start"].alias("start"), F.length(m["raw"]).alias("size"),
    )


def _raw(m: Column, value: Column | None = None) -> Column:
    return F.struct((m["value"] if value is None else value).alias("value"), m["start"].alias("start"), m["col"].alias("col"), m["value"].alias("raw"))


def scan(
    df: DataFrame, text_col: str = "text", types: DataFrame | None = None, placeholder_domains: list[str] = D.PLACEHOLDER_DOMAINS, value_patterns: list[tuple] = taxonomy.VALUE_PATTERNS, min_confidence: float = 0.0
) -> DataFrame:
    """All literal findings beside the other columns of ``df``.

    With a taxonomy, labels in a line raise the confidence of the values beside them.
    Accepted addresses and cards hide what overlaps them, in the detectors' order.
    """
    kept = [c for c in df.columns if c != text_col]
    rows = lines(readable(df, text_col), text_col).filter(F.col("n_bytes") <= D.MAX_LINE_BYTES)
    line = F.col("content")
    said = lambda keywords: reduce(lambda a, b: a | b, [F.contains(line, F.lit(k)) for k in keywords])
    patterns = [p for p in value_patterns if p[4] >= min_confidence]

    def secret(data_type: str, detector: str, pattern: str, keywords: list[str], confidence: float, bits: float) -> Column:
        """The findings of one value pattern in a line, or null where none of its keywords stands."""
        t = F.lit(data_type)
        fine = F.filter(D.matches(line, D.within_ascii(pattern), 1), lambda m: ~D.placeholder_secret(m["value"]) & (D.entropy(m["value"]) >= bits))
        return F.when(said(keywords), F.transform(fine, lambda m: F.struct(
            m["col"].cast("long").alias("col"), t.alias("data_type"), D.mask_secret(m["value"]).alias("masked"), D.value_hash(t, m["value"]).alias("value_hash"),
            F.lit(confidence).cast("double").alias("confidence"), F.lit(detector).alias("detector"), m["start"].alias("start"), F.length(m["value"]).alias("size"))))

    # every line is read once, whatever the number of detectors
    secrets = F.flatten(F.filter(F.array(*(secret(*p) for p in patterns)), lambda x: x.isNotNull())) if patterns else None
    likely = line.rlike("[0-9]{3}|@|[A-Z]{2}[0-9]{2}")
    marked = rows.filter(likely | said([k for p in patterns for k in p[3]]) if patterns else likely)
    mails = F.filter(
        F.transform(D.matches(line, D.EMAIL), lambda m: _finding("email", _raw(m), D.email_confidence(m["value"], line, m["start"], placeholder_domains), "email-format")), lambda f: f["confidence"] > 0
    )
    cards = F.filter(
        F.transform(
            F.filter(D.matches(line, D.CARD), lambda m: D.card_grouping(m["value"]) & ~D.decimal_part(line, m["start"], m["value"])),
            lambda m: _finding("credit_card", _raw(m, D.digits(m["value"])), D.card_confidence(D.digits(m["value"])), "luhn+iin"),
        ),
        lambda f: f["confidence"] > 0,
    )
    ssns = F.transform(F.filter(D.matches(line, D.SSN), lambda m: D.valid_ssn(m["value"])), lambda m: _finding("us_ssn", _raw(m), F.lit(0.6), "ssn-structure"))
    plain = lambda m: F.replace(m["value"], F.lit(" "))
    ibans = F.transform(F.filter(D.matches(line, D.IBAN), lambda m: D.valid_iban(plain(m)) & ~plain(m).isin(D.DOC_IBANS)), lambda m: _finding("bank_account", _raw(m, plain(m)), F.lit(0.8), "iban-mod97"))
    free = lambda held: lambda f: ~F.exists(held, lambda o: (f["start"] < o["start"] + o["size"]) & (f["start"] + f["size"] > o["start"]))
    found = marked.withColumn("mails", mails).withColumn("cards", F.filter(cards, free(F.col("mails")))).withColumn("ssns", F.filter(ssns, free(F.concat("mails", "cards"))))
    every = ["mails", "cards", "ssns", ibans]
    found = found.withColumn("f", F.explode(F.concat(*every, secrets) if patterns else F.concat(*every)))
    if types is not None:
        found = names.with_context(found, "content", types)
        beside = lambda *ids: F.arrays_overlap("context", F.array(*map(F.lit, ids)))
        raised = (
            F.when((F.col("f.data_type") == "email") & beside("email"), F.col("f.confidence") + 0.1)
            .when((F.col("f.data_type") == "credit_card") & beside("credit_card", "card_security_code", "card_expiry", "cardholder_name"), F.col("f.confidence") + 0.1)
            .when((F.col("f.data_type") == "us_ssn") & beside("us_ssn"), 0.92)
            .when((F.col("f.data_type") == "bank_account") & beside("bank_account"), 0.95)
            .otherwise(F.col("f.confidence"))
        )
    else:
        raised = F.col("f.confidence")
    values = found.withColumn("confidence", raised).filter(F.col("confidence") >= min_confidence)
    return values.select(*kept, "line", "f.col", "f.data_type", "f.masked", "f.value_hash", D.rounded(F.col("confidence")).alias("confidence"), "f.detector")


#: Folders of translation catalogs and names of community files.
CATALOG_FOLDERS = ("/i18n/", "/l10n/", "/locales/", "/locale/", "/translations/")
COMMUNITY_FILES = "CODE_OF_CONDUCT CODE-OF-CONDUCT CONTRIBUTING AUTHORS MAINTAINERS SECURITY CODEOWNERS CONTRIBUTORS GOVERNANCE SUPPORT".split()
TEST_FACTOR = 0.6


def contact_file(path: Column) -> Column:
    """Files whose addresses are published contacts."""
    folder = [F.contains(F.concat(F.lit("/"), F.lower(path)), F.lit(d)) for d in CATALOG_FOLDERS]
    name = [F.startswith(F.upper(F.substring_index(path, "/", -1)), F.lit(p)) for p in COMMUNITY_FILES]
    return reduce(lambda a, b: a | b, folder + name)


def file_rules(findings: DataFrame, path: str = "file", is_test: str = "test", min_confidence: float = 0.6) -> DataFrame:
    """Personal data in tests counts less, weak findings and contact addresses go. Needs ``class``."""
    c = F.when(F.col(is_test) & (F.col("class") != "credential"), F.floor(F.col("confidence") * TEST_FACTOR * 100 + 0.5) / 100).otherwise(F.col("confidence"))
    return findings.withColumn("confidence", c).filter((F.col("confidence") >= min_confidence) & ~(contact_file(F.col(path)) & (F.col("data_type") == "email")))
