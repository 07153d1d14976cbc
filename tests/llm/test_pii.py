import pytest

from planloom.llm.pii import find_personal, luhn, mod23, mod97, personal_spans, redact, redacted

CASES = [
    ("Send files to eslundnimer at slundnime dot co dot example and copy elif_s@example.org.", [("email", "eslundnimer at slundnime dot co dot example"), ("email", "elif_s@example.org")]),
    ("cc: ines [at] grum [dot] example; a+b@x.co.example", [("email", "ines [at] grum [dot] example"), ("email", "a+b@x.co.example")]),
    ("Hold 378 psi @ 20 degrees and set hanger rods @ 41 in. on center.", []),
    ("Questions go to René Jondpern, 944.882.8209.", [("name", "René Jondpern"), ("phone", "944.882.8209")]),
    ("Per call with Dolores ((799)932-9562) the unit ships.", [("name", "Dolores"), ("phone", "(799)932-9562")]),
    ("Phone (655) 298-1531, after hours +1 455 665 2115.", [("phone", "(655) 298-1531"), ("phone", "+1 455 665 2115")]),
    ("497-721-7099 fits the damper shaft; part 670.588.8700 does not.", []),
    ("Catalog sheet 4896122239 replaces 4538 7862; art work by others.", []),
    ("Serial 179-31-7983 was recorded on the nameplate.", []),
    ("Badge request for Anke Creimgyll (ID card 45996756-A) was approved.", [("name", "Anke Creimgyll"), ("id_number", "45996756-A")]),
    ("Fingerprint clearance on file for SHEILKWOLL, INES; passport no. Z76272170.", [("name", "SHEILKWOLL, INES"), ("id_number", "Z76272170")]),
    ("Certified payroll lists Sunil Fustroth, S.I.N. 082 256 549.", [("name", "Sunil Fustroth"), ("id_number", "082 256 549")]),
    ("Licence C-85104 is required for the sheet metal trade.", []),
    ("The neighbour at 7525 West Veiltock Boulevard, Suite 386, Tandmoston Mesa, NY 18485 complained.", [("address", "7525 West Veiltock Boulevard, Suite 386, Tandmoston Mesa, NY 18485")]),
    ("Site: 6031 GRAULHURN BLVD\n95292.", [("address", "6031 GRAULHURN BLVD\n95292")]),
    ("Ship it to Brumbater Mesa, CA 94523 - 1500 Walkgorn Drive, attention Dolores Boalkwowy.", [("address", "Brumbater Mesa, CA 94523 - 1500 Walkgorn Drive"), ("name", "Dolores Boalkwowy")]),
    ("Deliveries: use the gate behind 9514 Nirtstywy Rd. and ask for Hugh.", [("address", "9514 Nirtstywy Rd."), ("name", "Hugh")]),
    ("Extend 1516 linear feet of drive belt way above the ceiling.", []),
    ("Spoke to Ines Feisshill and Ines about Library; both agree.", [("name", "Ines Feisshill"), ("name", "Ines")]),
    ("Mr. Geixgund asked for more. Tess C. Zixmack's crew starts.", [("name", "Geixgund"), ("name", "Tess C. Zixmack")]),
    ("Grant access to the roof. Mark all conduit. Chip the slab. The rose window. Frank discussion. Art Room near Mason Wing.", []),
    ("GRANT ACCESS TO THE ROOF. MARK ALL ABANDONED CONDUIT. SPOKE TO LENA THEINPYLL AND GRANT ABOUT IT.", [("name", "LENA THEINPYLL"), ("name", "GRANT")]),
    ("Emergency contact: Quusgund, Maria, mobile (677) 315-0354.", [("name", "Quusgund, Maria"), ("phone", "(677) 315-0354")]),
    ("Chilmaby Bauxreter Partnership takes no exception.", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_find(text, expected):
    assert [(kind, text[s:e]) for kind, s, e in find_personal(text)] == expected


def test_a_checksum_decides_on_a_number_without_a_label():
    def numbers(text):
        return [text[s:e] for kind, s, e in find_personal(text) if kind == "id_number"]

    assert luhn("046454286") and not luhn("046454287") and mod23("12345678Z")
    assert numbers("Payroll lists 046 454 286 twice.") == ["046 454 286"] and numbers("Payroll lists 046 454 287 twice.") == []
    assert numbers("Badge request 12345678-Z was sent.") == ["12345678-Z"] and numbers("Badge request 12345678-A was sent.") == []
    assert numbers("Order 046 454 286 was sent, and 12345678-Z.") == numbers("Payroll for job no. 046454286.") == []


def test_checksums():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")
    assert mod23("12345678Z") and not mod23("12345678A")


def test_redaction_leaves_the_rest(spark):
    text = "  Mr. Geixgund,\n call (655) 298-1531 — or a@b.example!\t"
    assert redact(text) == "  Mr. [NAME],\n call [PHONE] — or [EMAIL]!\t"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    assert [r["redacted"] for r in redacted(df, "text").orderBy("id").collect()] == [redact(text), None]


def test_spans_in_code_points_repeats_and_long(spark):
    far = "😀 " * 60_000 + "mail a@b.example"
    df = spark.createDataFrame([(1, "😀 a@b.example", "mine"), (1, "😀 a@b.example", "mine"), (2, None, ""), (3, "", ""), (4, far, "")], "doc_id long, text string, pii_type string")
    got = sorted(tuple(r) for r in personal_spans(df, "doc_id", "text").collect())
    assert got == [(1, "email", 3, 13), (1, "email", 3, 13), (4, "email", len(far) - 10, len(far))]
    assert personal_spans(df.limit(0), "doc_id", "text").count() == 0


def test_names_are_read_to_their_end():
    for text, expected in {
        "Please contact Juan Carlos Garcia Lopez at noon.": "Please contact [NAME] at noon.",
        "attention Mary Ann Van Der Berg.": "attention [NAME].",
        "Ask for Ana Maria Torres please": "Ask for [NAME] please",
        "Spoke to Ludwig van der Rohe and Eva de la Cruz about it": "Spoke to [NAME] and [NAME] about it",
        "Juan Carlos Garcia Lopez wrote on Monday": "[NAME] wrote on Monday",
        "Dr. Priya Raman Iyer's crew": "Dr. [NAME]'s crew",
    }.items():
        assert redact(text) == expected


def test_checksums_decide_on_cards_accounts_and_contradicted_numbers():
    for text, expected in {
        "card 4111 1111 1111 1111 exp": "card [ID_NUMBER] exp",
        "visa 4111 1111 1111 1112": "visa 4111 1111 1111 1112",
        "pay GB82WEST12345698765432 now": "pay [ID_NUMBER] now",
        "pay GB83WEST12345698765432 now": "pay GB83WEST12345698765432 now",
        "serial no. DNI 12345678Z": "serial no. DNI [ID_NUMBER]",
        "serial no. DNI 12345678A": "serial no. DNI 12345678A",
        "invoice 4111111111111112": "invoice 4111111111111112",
    }.items():
        assert redact(text) == expected


def test_phones_of_other_countries():
    assert redact("call +33 1 42 68 53 00 or +34 612 345 678") == "call [PHONE] or [PHONE]"
    assert redact("tel +44 (0)20 7946 0958, model +12 345 part") == "tel [PHONE], model +12 345 part"
