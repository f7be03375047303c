import json
import re

import pytest

from sessionloom.llm.personal import _tax_check, feistel, find, find_personal, learn_names, name_pattern, pseudonym, redact, redact_json, redacted

KNOWN = [("given", n) for n in "Belkan Belkella Casvan Casviko Elovan Eloveth Griveth Griviko Norvella Zorvan Zorvisse Mirqane Mirqorra Haldius Ysevius Tavrane Haldane Tavrisse".split()]
KNOWN += [("surname", n) for n in "Brenkalund Brenkettel Jaskettel Jaskohorne Voskaquith Voskasken Liskasken Liskoux Umbvaquith Umbvoux Morvoux Morvalund Zeldriwick Jaskiwick Fosdiwick Fosdohorne".split()]
NAMES = name_pattern(KNOWN)


def values(text):
    return [(k, " ".join(text[a:b].split())) for a, b, k in find(text, NAMES)]


@pytest.mark.parametrize(("text", "want"), [
    ("see mailto:Casviko.Jaskettel@nimbeline.invalid for access", ("email", "Casviko.Jaskettel@nimbeline.invalid")),
    ("Reply-To: o'jaskoux＠x7.lumarch.test.", ("email", "o'jaskoux＠x7.lumarch.test")),
    ("mails fen_mor[at]x7[dot]lumarch[dot]test on", ("email", "fen_mor[at]x7[dot]lumarch[dot]test")),
    ("<zor-vos at corvane dot example> x", ("email", "zor-vos at corvane dot example")),
    ("请联系rill+ci (at) eu.quarrow.example。", ("email", "rill+ci (at) eu.quarrow.example")),
    ("her SSN is 980-61-0752 in clear", ("id_number", "980-61-0752")),
    ("ssn=917206937,", ("id_number", "917206937")),
    ("NIR 9 24 13 99 181 370 78 in", ("id_number", "9 24 13 99 181 370 78")),
    ("steuerliche IdNr. 02 528 767 629 leaked", ("id_number", "02 528 767 629")),
    ("，身份证：99427520990602009X，", ("id_number", "99427520990602009X")),
    ("Passport no. ZZ9008788 from", ("id_number", "ZZ9008788")),
    ("driving licence QX-528-154-39, asked", ("id_number", "QX-528-154-39")),
    ("national insurance: QQ 20 59 13 C.", ("id_number", "QQ 20 59 13 C")),
    ("my mobile (+12025550133) is", ("phone", "+12025550133")),
    ("my mobile ((030) 23125-414) is", ("phone", "(030) 23125-414")),
    ("ext 214 on 01.99.00.63.27.", ("phone", "01.99.00.63.27")),
    ("phone +49 30 23125\n854 now", ("phone", "+49 30 23125 854")),
    ("Tel. +44 (0)20 7946 0445", ("phone", "+44 (0)20 7946 0445")),
    ("livrer au Flat 10, 21b Harrow Fen Road\nWexley Cross.\nThen", ("address", "Flat 10, 21b Harrow Fen Road Wexley Cross")),
    ("寄到白渡市望桥路91号481室。", ("address", "白渡市望桥路91号481室")),
    ("lives at 75 bis avenue du Vieux-Lavoir, 00555 Montésol, says", ("address", "75 bis avenue du Vieux-Lavoir, 00555 Montésol")),
    ("to Altzollstr. 4b\n00400 Altfurten; ring", ("address", "Altzollstr. 4b 00400 Altfurten")),
    ("寄到Lindenhofstr. 88, 00009 Altfurten。", ("address", "Lindenhofstr. 88, 00009 Altfurten")),
    ("livrer au 71, lower mill lane, brannock.", ("address", "71, lower mill lane, brannock")),
    ("PO Box 4002, Tullowby。 Two runs", ("address", "PO Box 4002, Tullowby")),
    ("问过W. Jaskohorne了", ("person_name", "W. Jaskohorne")),
    ("customer eloviko umbvasken's", ("person_name", "eloviko umbvasken")),
    ("Ask Dr. Zorvan K. Voskettel-Liskoux", ("person_name", "Zorvan K. Voskettel-Liskoux")),
    ("Voskasken, Griveth |", ("person_name", "Voskasken, Griveth")),
    ("by Ravkiko Zeldroux here", ("person_name", "Ravkiko Zeldroux")),
])
def test_found(text, want):
    assert values(text) == [want]


@pytest.mark.parametrize("text", [
    "pin lortide-core@6.29.6", "remote git@vcs.internal:bridge.git now", "decorator @harjo_proxy on line 875", "lot 541-18-6437 of the boards",
    "build 2020.0942.1147 passed", "bound to 10.60.52.247:5550", "rows 100-211-775 skipped", "epoch 1716244536934 in", "branch zorvan/fix-156",
    "customer Jaskettel, today", "Regards,\nZorvan\n", "HarmarkRunner meets SkeulLint", "look at dot files at noon", "",
])
def test_no_case(text):
    assert values(text) == []


def test_endings_are_learned():
    stems, ends = learn_names(KNOWN)["surname"]
    assert "Zeldr" in stems and {"aquith", "ettel", "iwick"} <= set(ends)


def test_feistel_is_a_permutation():
    for size in (2, 10, 97, 1000):
        assert sorted(feistel(x, size, b"k", "t") for x in range(size)) == list(range(size))


def test_pseudonyms_keep_format_and_link_equal_values():
    one, two = pseudonym("+49 30 23125 919", "phone", b"k"), pseudonym("0049 30 23125919", "phone", b"k")
    assert one.startswith("+49 ") and one[-9:].replace(" ", "")[-8:] == two[-8:] and one != "+49 30 23125 919"
    assert pseudonym("980-61-0752", "id_number", b"k").replace("-", "") == pseudonym("980610752", "id_number", b"k")
    new = pseudonym("11010519491231002X", "id_number", b"k")  # a valid public example
    weights = [2 ** (17 - i) for i in range(17)]
    assert new[17] == "10X98765432"[sum(int(d) * w for d, w in zip(new[:17], weights, strict=True)) % 11]
    assert pseudonym("A@b.cd", "email", b"k") == pseudonym("a@B.cd", "email", b"k") != pseudonym("a@b.cd", "email", b"q")


def test_letters_of_numbers_are_permuted_too():
    for value, form in (("ZZ9008788", r"[A-Z]{2}\d{7}"), ("QX-528-154-39", r"[A-Z]{2}-\d{3}-\d{3}-\d{2}"), ("QQ 20 59 13 C", r"[A-Z]{2} \d\d \d\d \d\d [A-D]")):
        new = pseudonym(value, "id_number", b"k")
        assert re.fullmatch(form, new) and all(sum(a == b for a, b in zip(x, y, strict=True)) < len(x) for x, y in [(re.sub(r"[^A-Z]", "", value), re.sub(r"[^A-Z]", "", new))])
        assert pseudonym(value.replace(" ", "").replace("-", "").lower(), "id_number", b"k").upper() == re.sub(r"[ -]", "", new)
    assert len({pseudonym(f"AB{n:07d}", "id_number", b"k") for n in range(2000)}) == 2000
    assert len(pseudonym("a@b.example", "email", b"k")) == 24


def test_checked_numbers_stay_valid():
    for n in range(200):
        body = f"{1 + n % 2}{n % 100:02d}{1 + n % 12:02d}{n * 7919 % 10**8:08d}"
        new = pseudonym(f"{body}{97 - int(body) % 97:02d}", "id_number", b"k")
        assert new[0] in "12" and 1 <= int(new[3:5]) <= 12 and int(new[13:]) == 97 - int(new[:13]) % 97
    assert _tax_check("8609574271") == "9"  # a public example
    new = pseudonym("86 095 742 719", "id_number", b"k").replace(" ", "")
    assert _tax_check(new[:10]) == new[10] and new != "86095742719"


def test_no_length_hides_a_value():
    local = "a" * 300
    assert values(f"to {local}@b.example and") == [("email", f"{local}@b.example")]
    assert values("x" * 50 + ", " + "w" * 200 + "@" + "d" * 400 + ".example, y") == [("email", "w" * 200 + "@" + "d" * 400 + ".example")]
    names = name_pattern([*KNOWN, ("given", "Bo"), ("surname", "Ek"), ("surname", "Øst-Ny")])
    found = lambda t: [t[a:b] for a, b, k in find(t, names) if k == "person_name"]
    assert found("ask Bo Ek now") == ["Bo Ek"] and found("ask Bo Øst-Ny now") == ["Bo Øst-Ny"]


def test_redaction_changes_nothing_else():
    raw = '{"type":"text", "text": "\\u00e9crire \\u00e0 a.b@c.example \\"x\\"", "n": 1.0, "k\\/": "h\\u00e9"}'
    new = redact_json(raw, NAMES, b"k")
    assert json.loads(new)["text"].startswith("écrire à [email:") and new.endswith('"n": 1.0, "k\\/": "h\\u00e9"}')
    assert redact_json('{"a": "x y"', NAMES, b"k") == '{"a": "x y"' and redact_json(None, NAMES, b"k") is None
    assert "a.b@c.example" not in redact_json('{"a": "a.b@c.example', NAMES, b"k")
    assert redact("plain", NAMES, b"k") == "plain" and redact("x", None, b"k") == "x"


def test_tables(spark):
    rows = [("1", '{"text": "SSN 917-20-6937 and SSN 917-20-6937"}', 1), ("1", '{"text": "SSN 917-20-6937"}', 2), ("2", "{", 3), ("3", None, 4), (None, '{"a": "a@b.example"}', 5), ("4", "", 6), ("5", '["tel:646.555.0129", {"b": ["a@b.example"]}]', 7)]
    df = spark.createDataFrame(rows, "record_id string, raw string, kind int")
    got = sorted(map(tuple, find_personal(df, KNOWN, True).collect()))
    assert got == [("1", "id_number", "917-20-6937"), ("5", "email", "a@b.example"), ("5", "phone", "646.555.0129")]
    assert find_personal(df.limit(0), KNOWN, True).count() == 0
    out = {r.kind: r.raw for r in redacted(df, "raw", KNOWN, True, b"k").collect()}
    assert len(out) == 7 and out[4] is None and out[6] == "" and "917-20-6937" not in out[1]
    long = "x " * 200000 + "a@b.example"
    assert values(long) == [("email", "a@b.example")]
