import pytest
from pyspark.sql import functions as F

from veilgrid.functions import detect as D
from veilgrid.functions import taxonomy
from veilgrid.operators import literals, names


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def luhn(prefix):
    total = sum(int(c) * (1 if k % 2 else 2) - (9 if k % 2 == 0 and int(c) > 4 else 0) for k, c in enumerate(reversed(prefix)))
    return prefix + str(-total % 10)


def test_card_networks(spark):
    numbers = [luhn(p) for p in ("453210983172650", "522109837265091", "222309837265091", "37282736450918", "356809837265091", "601109837265091", "629109837265091", "123409837265091", "34098372650918")]
    assert column(spark, numbers + ["4111111111111111", "4532109831726501", "4999999999999991"], D.card_confidence) == [0.85, 0.85, 0.85, 0.85, 0.85, 0.8, 0.8, 0.0, 0.85, 0.0, 0.0, 0.0]
    assert column(spark, ["4532 1098 3172 6508", "4532-1098-3172-6504", "4532 1098-3172 6504", "3728 273645 09181", "4097 1 829805 0 0", "4532109831726508"], D.card_grouping) == [True, True, False, True, False, True]


def test_validators(spark):
    assert column(spark, ["536-22-1234", "000-12-1234", "666-12-1234", "912-12-1234", "123-00-1234", "123-12-0000", "078-05-1120"], D.valid_ssn) == [True] + [False] * 6
    assert column(spark, ["GB82WEST12345698765432", "DE89370400440532013000", "GB82WEST12345698765433", "FR7630006000011234567890189"], D.valid_iban) == [True, True, False, True]
    assert column(spark, ["123456", "12", "987654", "0000001", "135792", "890123"], D.trivial_digits) == [True, True, True, True, False, True]
    got = column(spark, ["aabb", "aaaa", "abcd"], D.entropy)
    assert got == pytest.approx([1.0, 0.0, 2.0])
    assert column(spark, ["jane@corp.io", "j@corp.io"], lambda v: D.mask_value(F.lit("email"), v)) == ["j***@corp.io", "j***@corp.io"]
    assert column(spark, ["4532109831726508"], lambda v: D.mask_value(F.lit("credit_card"), v)) == ["************6508"]
    assert column(spark, ["ghp_abcdefghijk", "short"], D.mask_secret) == ["ghp_********", "********"]


def test_emails(spark):
    lines = ["mail jane.roe@corp.io now", "x support@corp.io", "a@b.example.com", "author: jane@corp.io", "pkg/jane@corp.io", "jane@corp.museum", "jane@Outer.innerClass", "test123@gmail.com", "this@Outer.go"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, text string")
    assert [r.confidence for r in literals.email_candidates(df).orderBy("id", "line").collect()] == [0.8, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0]


def test_scan_of_a_file(spark):
    token = "ghp_" + "aZ3kQ9xW7rT1vB5nM8cL2pD6sF4gH0jK" + "Y2u4"
    card = luhn("453210983172650")
    text = f"ssn: 536-22-1234\ncard number {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}\nmail é jane.roe@corp.io\ntoken = {token}\niban GB33BUKB20201555555555\n1424.4377811094455 x\niban FR7630006000011234567890189\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "a\0" + card), (4, "z" * 5000 + card)], "id int, text string")
    rows = sorted((r.line, r.col, r.data_type, r.confidence, r.detector) for r in literals.scan(df, types=taxonomy.data_types(spark)).collect())
    assert rows == [
        (1, 6, "us_ssn", 0.92, "ssn-structure"),
        (2, 13, "credit_card", 0.95, "luhn+iin"),
        (3, 9, "email", 0.9, "email-format"),
        (4, 9, "access_token", 0.95, "github-token"),
        (7, 6, "bank_account", 0.95, "iban-mod97"),
    ]


def test_names(spark):
    types = taxonomy.data_types(spark)
    cases = {
        "email": ("email", 0.9, None), "userEmail": ("email", 0.85, None), "maskedPhone": ("phone", 0.85, "masked"), "emailValidator": None, "isEmail": None, "phonePlatform": None, "walletAddress": None, "tokenExpirationDate": None, "githubTrackData": None, "home_address": ("address", 0.9, None), "customer_first_name": ("person_name", 0.85, None),
        "SSNNumber": ("us_ssn", 0.72, None), "workemails": ("email", 0.55, None), "microphone": None, "ip": ("ip_address", 0.65, None), "sha256Email": ("email", 0.72, "sha256"), "cardLast4": None, "x": None, "c_phone": ("phone", 0.72, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r.name: r.named and (r.named.data_type, round(r.named.confidence, 4), r.named.transform) for r in names.classify(df, "name", types).collect()}
    assert got == cases
    assert column(spark, ["phoneNumber", "USER_EMAIL_ADDR", "SSNNumber", "user.email2"], names.tokens) == [["phone", "number"], ["user", "email", "addr"], ["ssn", "number"], ["user", "email", "2"]]
    assert column(spark, ["maskPhone", "hashMap", "sha256Hex", "verifyHash", "encryptCard"], names.sanitizer) == ["masked", None, "sha256", None, "encrypted"]
    fields = spark.createDataFrame([("model.Customer", "name"), ("Card", "holderName"), ("File", "name"), ("Cardholder", "name")], "owner string, field string")
    assert {(r.owner, r.named and r.named.data_type) for r in names.classify_fields(fields, "owner", "field", types).collect()} == {("model.Customer", "person_name"), ("Card", "cardholder_name"), ("File", None), ("Cardholder", "cardholder_name")}


def test_taxonomy_merge_and_lookup(spark):
    base = taxonomy.data_types(spark)
    extra = taxonomy.load(spark, '{"data_types": [{"id": "email", "category": "contact", "class": "phi", "patterns": ["electronic mail"]}, {"id": "badge_id", "category": "identity", "class": "pii", "patterns": ["badge id"]}]}')
    merged = taxonomy.merge(base, extra)
    assert merged.count() == len(taxonomy.DATA_TYPES) + 1
    rows = spark.createDataFrame([("email",), ("badge_id",), ("pci",), ("unheard",)], "data_type string")
    assert {(r.data_type, r["class"], r.category, r.raised) for r in taxonomy.lookup(rows, merged).collect()} == {("email", "phi", "contact", True), ("badge_id", "pii", "identity", False), ("pci", "pci", "custom", True), ("unheard", "pii", "custom", False)}
    with pytest.raises(ValueError):
        taxonomy.load(spark, '{"data_types": [{"id": "a", "class": "pii", "pattern": ["x"]}]}')
