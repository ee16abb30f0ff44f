"""Splitting, sentences and personal information."""

import random
import re

import pytest

from clausemill.llm import privacy as P, sentences as S, splitting as X

NAMES = [("Ansel", "given"), ("Thea", "given"), ("Zoë", "given")] + [(a + b, "family") for a in ("Bren", "Cald", "Dorn", "Elk", "Fen", "Kel") for b in ("bury", "dale", "mont", "ridge", "wick", "worth", "ley")]
FORMS = P.NameForms(NAMES)


def kinds(text):
    return [(text[a:b], k) for a, b, k in P.find(text, FORMS)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@mail.example.org.", [("a.b+c@mail.example.org", "email")]),
        ("write to x_y [at] mail [dot] example [dot] org now", [("x_y [at] mail [dot] example [dot] org", "email")]),
        ("mail bo at tannery dot test.", [("bo at tannery dot test", "email")]),
        ("billed @ $69.10 per unit and electricity @ 9.6% above", []),
        ("call (212) 555-0168 or 1-713-555-0132.", [("(212) 555-0168", "phone"), ("1-713-555-0132", "phone")]),
        ("K. Caldmont (206-555-0107);", [("K. Caldmont", "name"), ("206-555-0107", "phone")]),
        ("Tel +44 20 7946 0885", [("+44 20 7946 0885", "phone")]),
        ("call ４０４－５５５－０１１０ now", [("４０４－５５５－０１１０", "phone")]),
        ("Parcel No. 415-555-0138 and invoice 021-334-0995-5 relate", []),
        ("Drawing no. 914-49-2018 shows", []),
        ("loan is no. 4410-2231-8787.", []),
        ("digits XXX-XX-4661 were masked", []),
        ("SSN: 951-26-1328, passport no. X2598139, D.L. no. K207-6732-7341", [("951-26-1328", "id_number"), ("X2598139", "id_number"), ("K207-6732-7341", "id_number")]),
        ("Tax identification of Kelbury Leasing Co. is 00-M882480", []),
        ("residing at 7427-B Quarry Parkway, Unit 3", [("7427-B Quarry Parkway", "address")]),
        ("mailed to Twelve W. Weir Avenue, Unit 194", [("Twelve W. Weir Avenue", "address")]),
        ("Sheet A-37 Ropewalk Street elevation; sign facing Kiln Avenue", []),
        ("Attn: Dr. Kelmont, Caldwick Capital Corp., telephone", [("Kelmont", "name")]),
        ("Attn: Fenworth, Yorick, Fenworth Interiors LLC", [("Fenworth, Yorick", "name")]),
        ("handed to THEA KELBURY and Mr. O'Caldley on May 8", [("THEA KELBURY", "name"), ("O'Caldley", "name")]),
        ("Thea Kelmont Leasing Co. and Kelwick & Fenley LLP", []),
        ("The Fendale Building and Elkridge Lane", []),
        ("set out in Exhibit J. Kelmont, Petra signed as guarantor", [("Kelmont, Petra", "name")]),
        ("Witness: Ansel Kelmont Dornley Realty Partners LP guarantees", [("Ansel Kelmont", "name")]),
        ("", []),
    ],
)
def test_entities(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("mail", ["JDOE (AT) FIRM (DOT) COM", "jdoe [At] firm [Dot] com", "jdoe ( at ) firm ( dot ) com", "JDoe At Firm Dot Com"])
def test_spelt_out_mail_in_any_case(mail):
    assert kinds(f"write to {mail}, now") == [(mail, "email")]


def test_replacement_is_typed_consistent_and_distinct():
    text = "Attn: Thea Kelmont. Later Kelmont, Thea signed as guarantor; Ansel Fenwick signed as guarantor. Mail T@X.EXAMPLE.ORG, SSN ９５１－２６－１３２８."
    spans = P.find(text, FORMS)
    plain = P.replace(text, spans, None)
    assert plain.count("[NAME_1]") == 2 and "[NAME_2]" in plain and "[EMAIL_1]" in plain and "[ID_NUMBER_1]" in plain
    fresh = P.replace(text, spans, b"key")
    assert fresh == P.replace(text, spans, b"key") != P.replace(text, spans, b"other")
    assert not any(text[a:b] in fresh for a, b, _ in spans)
    number = re.search("SSN ([０-９－]+)", fresh)[1]
    assert re.fullmatch("[０-９]{3}－[０-９]{2}－[０-９]{4}", number)
    given, family = re.search(r"Attn: (\S+) (\S+?)\.", fresh).groups()
    assert f"{family}, {given}" in fresh and given.endswith("a")
    assert P.replace("x", [], b"k") == "x"


UNSEEN = [
    ("Attn: 王小明, room 5", "王小明", "name"), ("联系人：李小龙，电话", "李小龙", "name"), ("Меня зовут Иван Петров и я", "Иван Петров", "name"),
    ("договор подписал Сергей Иванович Кузнецов вчера", "Сергей Иванович Кузнецов", "name"), ("담당자: 김철수, 서울", "김철수", "name"), ("My name is Priya Raghunathan.", "Priya Raghunathan", "name"),
    ("We met Robert Johnson at noon.", "Robert Johnson", "name"), ("I spoke with Hans Gruber, who left", "Hans Gruber", "name"), ("call 020 7946 0958 today", "020 7946 0958", "phone"),
    ("ring 01 42 68 53 00 soon", "01 42 68 53 00", "phone"), ("her national insurance number is QQ123456C", "QQ123456C", "id_number"), ("Aadhaar 2341 2341 2346", "2341 2341 2346", "id_number"),
    ("DNI 12345678Z", "12345678Z", "id_number"), ("wohnt Hauptstraße 12, Berlin", "Hauptstraße 12", "address"), ("habite 12 rue de la Paix, Paris", "12 rue de la Paix", "address"),
    ("vive en Calle Mayor 3, Madrid", "Calle Mayor 3", "address"), ("mail " + "x" * 300 + ".a@mail.example.org", "x" * 300 + ".a@mail.example.org", "email"),
]


@pytest.mark.parametrize(("text", "value", "kind"), UNSEEN)
def test_wording_of_other_countries(text, value, kind):
    assert kinds(text) == [(value, kind)]
    fresh = P.replace(text, P.find(text, FORMS), b"key")
    assert value not in fresh and P.script(P.replace(text, P.find(text, FORMS), b"key")[text.index(value) :]) == P.script(value)


@pytest.mark.parametrize("text", ["Rate Mark Up and Grace Period", "The Paul Revere Building is old", "a John Deere Leasing Co. unit", "DNI 12345678A", "Aadhaar 2341 2341 2345", "Platz 9 ist frei"])
def test_no_case_of_other_countries(text):
    assert kinds(text) == []


def test_given_names_keep_their_gender(spark):
    names = spark.createDataFrame([(f, "family") for f in ("kelmont", "fenworth", "dornley")], "token string, kind string")
    rows = [("a", "Ms. Robin Kelmont and Mr. Zoran Fenworth"), ("b", "Attn: Robin Dornley. Attn: Zoran Kelmont."), ("c", "Attn: Margaret Kelmont. Attn: Joshua Kelmont.")]
    out = {r.document_id: r.text for r in P.redacted(spark.createDataFrame(rows, "document_id string, normalized_text string"), names, "key").collect()}
    given = {d: re.findall(r"(?:Ms\.|Mr\.|Attn:) (\w+) \w+", t) for d, t in out.items()}
    assert given["a"] == given["b"] and all(w[0].endswith("a") and not w[1].endswith("a") for w in given.values())


def test_machines_agree():
    words = [("Mr. ", "title"), ("Mr", "title"), ("Mr.", "title"), ("by ", "cue"), ("y ", "cue")]
    import builtins

    real, text = builtins.__import__, "by Mr. X by Mr Y"
    found = P._machine(words)(text)
    try:
        builtins.__import__ = lambda name, *a: (_ for _ in ()).throw(ImportError()) if name == "ahocorasick" else real(name, *a)
        plain = P._machine(words)(text)
    finally:
        builtins.__import__ = real
    assert found == plain and len(found) > 5


def test_privacy_frames(spark):
    names = spark.createDataFrame(NAMES, "token string, kind string")
    long = "filler words " * 20000 + "call 212-555-0168"
    rows = [("a", "call 212-555-0168", 1), ("a", "call 212-555-0168", 1), ("b", None, 1), ("c", "", 1), (None, "call 212-555-0168", 1), ("d", long, 1)]
    frame = spark.createDataFrame(rows, "document_id string, normalized_text string, kind int")
    assert sorted((r.document_id, r.start_char) for r in P.entities(frame, names, 'k').collect()) == [("a", 5), ("d", len(long) - 12)]
    red = {r.document_id: (r.text, r.redaction_codes) for r in P.redacted(frame, names).collect()}
    assert red["a"] == ("call [PHONE_1]", ["phone"]) and red["b"] == (None, []) and red["c"] == ("", [])
    assert P.entities(frame.limit(0), names, 'k').count() == 0
    assert P.entities(frame, names.limit(0), 'k').count() == 2


def test_surrogates_are_distinct_over_the_corpus(spark):
    letters = "abcdefghijklmnop"
    families = [f"Kel{a}{b}mont" for a in letters for b in letters]
    names = spark.createDataFrame([("Thea", "given"), ("Ansel", "given")] + [(f, "family") for f in families], "token string, kind string")
    rows = [(str(i), f"Attn: {'Thea' if i % 2 else 'ANSEL'} {f}, SSN 9-{i // 100:02}-{i % 100:02}, call 212-555-{i:04} or 212-555-{i:04} ext 7, mail m{i}@x.test, at {i + 1} Quarry Street") for i, f in enumerate(families)]
    out = {r.document_id: r.text for r in P.redacted(spark.createDataFrame(rows, "document_id string, normalized_text string"), names, "key").collect()}
    form = re.compile(r"Attn: (\S+) (\S+), SSN (\d-\d\d-\d\d), call (212-555|212-\d{3})-(\d{4}) or (\S+)-(\d{4}) ext \d, mail (\S+)@x.test, at (\d+ \w+) Street")
    found = [form.fullmatch(out[i]).groups() for i, _ in rows]
    assert len({f[1].lower() for f in found}) == len(families) and len({f[0].lower() for f in found}) == 2
    assert all(f[0].endswith("a") == (i % 2 == 1) and f[0].isupper() == (i % 2 == 0) for i, f in enumerate(found))
    assert all(f[3:5] == f[5:7] for f in found)
    for place in ((2,), (3, 4), (7,), (8,)):
        assert len({tuple(f[p] for p in place) for f in found}) == len(families)
    olds = {w for _, text in rows for w in re.findall(r"[\w-]*\d[\w-]*|Kel\w+mont", text) if len(w) > 6}
    assert not any(w in olds for text in out.values() for w in re.findall(r"[\w-]*\d[\w-]*|Kel\w+mont", text))


@pytest.mark.parametrize("text", ["passport \u017f1234567 shown", "passport \u212a1234567 shown", "SSN ٩٥١-٢٦-١٣٢٨ shown"])
def test_surrogates_of_unusual_signs(text):
    spans = P.find(text, FORMS)
    fresh = P.replace(text, spans, b"key")
    assert spans and fresh != text and len(fresh) == len(text)


def test_attempts_settle_all_clashes(spark):
    units = [("phone", f"212555{i:04}") for i in range(3000)] + [("id_number", f"{i:05}") for i in range(20_000)] + [("word", f"kelmont{i}") for i in range(3000)]
    moved = {(r.sort, r.unit): r.attempt for r in P.attempts_over(spark.createDataFrame([(*u, None) for u in units], "sort string, unit string, gender string"), b"key").collect()}
    fresh = {u: (u[0], P.fresh_unit(b"key", *u, moved.get(u, 0))) for u in units}
    assert len(set(fresh.values())) == len(units) and not set(fresh.values()) & set(units) and moved
    assert moved == P.attempts_in(b"key", units)
    with pytest.raises(ValueError):
        P.attempts_over(spark.createDataFrame([("id_number", f"{i:05}", None) for i in range(30_000)], "sort string, unit string, gender string"), b"key")


def texts():
    random.seed(2)
    words = lambda n: " ".join(random.choice(["rent", "lease", "tenant", "day."]) for _ in range(n))
    return ["x" * 5000, words(3000), "\n\n".join(words(40) for _ in range(60)), "行" * 3000 + "。" + "文" * 2000, words(5) + "\n" + "y" * 2600 + " " + words(900)]


@pytest.mark.parametrize("size", [1 << 20, 3000])
def test_pieces_cover_and_overlap(size):
    for text in texts():
        found = X.split_text(text, 1200, 120, size)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        for (a, b), (c, d) in zip(found, found[1:], strict=False):
            assert a < c <= b < d and b - c <= 120
        assert all(0 < b - a <= 1200 for a, b in found)
        assert "".join(text[max(a, e) : b] for (a, b), e in zip(found, [0, *(b for _, b in found)], strict=False)) == text
    found = X.split_text(texts()[2], 1200, 120)
    assert sum(texts()[2][b - 2 : b] == "\n\n" for _, b in found) >= len(found) - 1
    assert X.split_text("", 10, 2) == [] and X.split_text("abc", 10, 2) == [(0, 3)]


def test_split_frames(spark):
    rows = [("a", None, texts()[1]), ("a", None, texts()[1]), ("b", "k", None), ("c", "k", ""), ("d", "k", "x" * 1200), ("e", "k", "x" * 1201)]
    frame = spark.createDataFrame(rows, "document_id string, piece string, text string")
    found = X.split_long(frame, ["document_id", "piece"], "text", 1200)
    assert found.columns[0] == "document_id"
    ids = [r[0] for r in found.collect()]
    assert set(ids) == {"a", "e"} and ids.count("e") == 2
    assert X.split_long(frame.limit(0), ["document_id"], "text", 1200).count() == 0
    with pytest.raises(ValueError):
        X.split_long(frame, ["document_id"], "text", 100, 60)


def test_giant_columns_are_split_by_ranges(spark):
    whole = [t for t in texts() for t in (t * 3, t + "\n" + t)]
    want = sorted((str(i % 3 or None), n, a, b, t[a:b]) for i, t in enumerate(whole) for n, (a, b) in enumerate(X.split_text(t, 1200, 120, 4800)))
    frame = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(whole)], "k int, text string")
    found = X.split_long(frame, ["k"], "text", 1200, range_size=4800)
    assert sorted((str(r.k), r.piece, r.start_char, r.end_char, r.piece_text) for r in found.collect()) == want


def test_split_files_by_ranges(spark, tmp_path):
    text = "\n".join(f"Zeile {i}: Müller zahlt 行 {'wort ' * (i % 30)}" for i in range(4000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    found = X.split_files(spark, [str(tmp_path / "big.txt"), str(tmp_path / "empty.txt")], 1200, 120, range_bytes=30_000).orderBy("piece").collect()
    assert [(r.piece, r.start_char, r.end_char) for r in found] == [(n, a, b) for n, (a, b) in enumerate(X.split_text(text, 1200, 120, 30_000))]
    column = X.split_long(spark.createDataFrame([("x", text)], "k string, t string"), ["k"], "t", 1200, range_size=30_000).orderBy("piece").collect()
    assert [(r.piece, r.start_char, r.end_char, r.piece_text) for r in column] == [(r.piece, r.start_char, r.end_char, r.piece_text) for r in found]
    assert found[0].start_char == 0 and found[-1].end_char == len(text)
    assert all(text[r.start_char : r.end_char] == r.piece_text and len(r.piece_text) <= 1200 for r in found)
    assert all(a.start_char < b.start_char <= a.end_char < b.end_char for a, b in zip(found, found[1:], strict=False))
    assert X.split_files(spark, [str(tmp_path / "empty.txt")], 1200).count() == 0
    assert X.split_files(spark, ["file://" + str(tmp_path / "big.txt")] * 2, 1200).filter("piece = 0").count() == 1
    with pytest.raises(FileNotFoundError):
        X.split_files(spark, [str(tmp_path / "none.txt")], 1200)


def test_ranges_see_only_their_window(spark):
    """A range cut from its window alone gives what it gives in the whole text."""
    for text in texts():
        data, halo = text.encode(), X.halo_bytes(1200)
        for low in range(0, len(data), 2500):
            high = min(len(data), low + 2500)
            base = max(0, low - halo)
            part = X.range_pieces(data[base : high + halo], base, low, high, len(data), 1200, 120)
            whole = X.range_pieces(data, 0, low, high, len(data), 1200, 120)
            assert part == whole


def test_stretches_add_up(spark, monkeypatch):
    monkeypatch.setattr(X, "STRETCH", 3)
    text = "\n".join(f"line {i} {'word ' * (i % 9)}" for i in range(900))
    found = X.split_long(spark.createDataFrame([(1, text), (2, text[::-1])], "k int, t string"), ["k"], "t", 300, 40, range_size=1500).collect()
    for k, t in ((1, text), (2, text[::-1])):
        assert sorted((r.piece, r.start_char, r.end_char) for r in found if r.k == k) == [(n, a, b) for n, (a, b) in enumerate(X.split_text(t, 300, 40, 1500))]


def test_exported_texts_are_cut_by_byte_ranges(spark, tmp_path):
    rows = [("a b\nc",), (None,), ("",), ("é" * 40,)]
    paths = X.export_texts(spark.createDataFrame(rows, "t string").coalesce(1), "t", str(tmp_path / "out"))
    found = X.split_files(spark, paths, 30, 5, range_bytes=16).orderBy("piece").collect()
    assert found[-1].end_char == len("a b\nc\n\n" + "é" * 40 + "\n\n")


TRAINING = [
    "The tenant pays. The owner agrees. Tenant waives. Rent is due.\n\nThe lease ends. Upon notice it ends.",
    "Der Mieter zahlt. Die Miete steigt.\n\nDie Kaution ist fällig. Der Vertrag endet.",
    "租金每年上涨。押金退还。\n\n押金在交还后退还。承租人付款。",
    "किराया बढ़ेगा। जमा राशि लौटेगी।\n\nकिराया देगा। जमा राशि है।",
] * 30


def model(texts):
    left, right = {}, {}
    for t in texts:
        S.token_counts(t, left, right)
    return S.Model(left, right).fit(texts)


MODEL = model(TRAINING)


@pytest.mark.parametrize(
    "units",
    [
        ["The tenant pays $1,234.50. The owner agrees."[:26], "The owner agrees."],
        ["See Sec. 4.2, Art. XII and Ex. B-1, e.g. as amended.", "Rent is due."],
        ["The guarantor moved to the U.S.", "The tenant pays."],
        ["The dock closes at 6 p.m.", "Tenant waives."],
        ["Rent is due by 5 p.m. on Monday."],
        ['"Who may enter?" Fenley asked on May 1.', "The lease ends."],
        ['Owner wrote: "It is lost. No refund." and kept it.', "The lease ends."],
        ['The clause (which reads "Time is short. No waiver.") survives.'],
        ["(Tenant keeps the dock.)", "The lease ends."],
        ["It ran from month to month ... and was never renewed."],
        ["What happens?!", "Upon notice it ends."],
        ["Der Nachtrag Nr. 78 vom 3. Juli 2018 (s. o.) bleibt i. d. R. gültig.", "Die Miete steigt."],
        ["„Wer zahlt?“, fragte Fenley am 3. März.", "Der Mieter zahlt."],
        ["Hr. Kelmont vertritt die Fenley GmbH & Co. KG, vgl. Anlage 2.", "Die Miete steigt."],
        ["« Qui paie ? » demanda le preneur.", "Le bail prend effet."],
        ["¿Quién paga según el art. 23.9?", "La renta sube."],
        ["Договор действует до конца 2012 г.", "Арендатор платит."],
        ["Адрес: г. Дубравск, ул. Заречная, д. 26.", "«Кто платит?» — спросил арендатор."],
        ["يدفع المستأجر الأجرة.", "من يدفع؟"],
    ],
)
def test_sentence_units(units):
    text = "  " + "  ".join(units) + " "
    assert [text[a:b] for a, b in S.units(text, MODEL)] == units


def test_units_without_blanks():
    text = "租金每年上涨1.6%。（业主可保留屋顶。）“谁付款？”承租人于2012年问道。押金退还。"
    assert [text[a:b] for a, b in S.units(text, MODEL)] == ["租金每年上涨1.6%。", "（业主可保留屋顶。）", "“谁付款？”承租人于2012年问道。", "押金退还。"]
    text = "किराया 4.2 प्रतिशत बढ़ेगा। डॉ. मेहरवाल ने रु. 53 दिए।"
    assert [text[a:b] for a, b in S.units(text, MODEL)] == ["किराया 4.2 प्रतिशत बढ़ेगा।", "डॉ. मेहरवाल ने रु. 53 दिए।"]
    text = "ผู้เช่าต้องชำระ 49,769 บาท ตามข้อ 13.5 ผู้ให้เช่า เงินประกันจะคืน"
    assert [text[a:b] for a, b in S.units(text, MODEL)] == ["ผู้เช่าต้องชำระ 49,769 บาท", "ตามข้อ 13.5 ผู้ให้เช่า", "เงินประกันจะคืน"]
    text = "Die Kosten steigen.Der Mieter zahlt."
    assert [text[a:b] for a, b in S.units(text, MODEL)] == ["Die Kosten steigen.", "Der Mieter zahlt."]


def test_headings_breaks_and_cover():
    text = "28.7 Default\n\nThe tenant\nwaives.  The owner agrees.\n \nEnd"
    found = [text[a:b] for a, b in S.units(text, MODEL)]
    assert found == ["28.7 Default", "The tenant\nwaives.", "The owner agrees.", "End"]
    assert "".join(re.sub(r"\s", "", u) for u in found) == re.sub(r"\s", "", text)
    assert S.units("", MODEL) == [] and S.units(" \n ", MODEL) == []


def test_sentence_frames(spark):
    long = "The tenant pays. " * 5000
    rows = [(1, TRAINING[0], "x"), (1, TRAINING[0], "x"), (2, None, "x"), (3, "", "x"), (None, "The end.", "x"), (4, long, "x"), (5, "no mark at all", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start_char string")
    found = S.sentence_units(frame).collect()
    counts = {i: sum(r.doc_id == i for r in found) for i in (1, 2, 3, 4, 5)}
    assert counts == {1: 6, 2: 0, 3: 0, 4: 5000, 5: 1}
    assert S.sentence_units(frame.limit(0), model=MODEL).count() == 0


def test_sentences_are_the_models_choice():
    """Without fitting no mark ends anything; what is fitted on decides about an unknown abbreviation."""
    text = "Rent covers approximat. Fenley and the roof. Tenant waives."
    empty = S.Model({}, {})
    assert len(S.units(text, empty)) == 1
    more = TRAINING + ["The owner pays approximat. half of the rent, approximat. two days late. Tenant waives."] * 40
    assert [len(S.units(text, m)) for m in (MODEL, model(more))] == [3, 2]
