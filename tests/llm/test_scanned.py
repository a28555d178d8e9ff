import pytest

pytest.importorskip("folioforge.llm")
from folioforge.llm import furniture as FU
from folioforge.llm import scanned as S

PLAIN = "The petition discloses no error apparent on the face of the record and the short-term tenant was examined as a witness at the hearing."


NAMES = ["ORVATH", "CALVIM", "ELGESH", "DUSKARD", "NESKUND", "PELLOVA", "BRASKIM", "ULMOST"]


def book(at: int, head: str, page: str) -> str:
    """A page of wrapped prose with a head and a page number in the middle of a sentence."""
    return f"The plea of limitation was urged before the learned judge of the\ntrial court and was rejected by him on the evidence of the attesting\n{page}\n{head}\nwitness number {at}, who had seen the deed signed."


def pages():
    heads = [f"{NAMES[i % 8]} {NAMES[(i + 3) % 8]} VERSUS UNION OF {NAMES[(i + 5) % 8]}" for i in range(12)]
    series = "THE NORTHERN LAW SERIES  [19{:02d}] {} N.L.S."
    rows = [(f"d{i}", p, book(i, heads[i] if p % 2 else series.format(40 + i, i), f"- {100 * i + p} -")) for i in range(12) for p in (1, 2, 3, 4)]
    return rows + [(f"d{i}", 9, "FACTS OF THE CASE\n\nThe tenant was examined as a witness at the hearing of the suit, and he\ndid not deny the signature on the deed.") for i in range(12)]


def remover(spark, rows):
    return FU.Remover(FU.learn(spark.createDataFrame(rows, "doc string, page int, text string"), S.CONFUSED)[0])


def test_furniture(spark):
    r = remover(spark, pages())
    prose = "The petition discloses no error apparent on the face of the record\nand the tenant was examined as a witness at the hearing, although he\nhad not been named."
    for line, want in [
        ("THE N0RTHERN LAW SERIES  [1983] 12 N.L.S.", {"header"}),
        ("THE NORTHEKN LAW SERIES  [1983] 12 N.L.S.    833", {"header", "page_number"}),
        ("TARVESH OSTRIM VERSUS UNION OF THORGARD", {"header"}),
        ("- 4O6 -", {"page_number"}),
        ("FACTS OF THE CASE", set()),
    ]:
        kinds, body, _ = r.strip(f"{line}\n{prose}")
        assert kinds == want and (line not in body) == bool(want), line
    lost = "The rival claims to the medical TARVESH OSTRIM VERSUS UNION OF THORGARD certificate were compromised."
    assert r.strip(lost)[0] == {"header"} and "TARVESH" not in r.strip(lost)[1]
    assert r.strip("In Elgost v. Ranvask & Sons, this Court noticed that part-payment must be pleaded.")[0] == set()
    # a line of no known form is furniture where it breaks a sentence
    assert r.strip(prose.replace("record\n", "record\nThird Circuit Notes\n"))[0] == {"header"}
    assert r.strip("")[:2] == (set(), "") and r.strip("FACTS OF THE CASE") == (set(), "FACTS OF THE CASE", [])
    assert r.strip("WHOLLY IN CAPITALS " * 3000)[0] == set()


def test_own_pages(spark):
    """A head that only one document has, and a number that runs with its pages, are told by that document alone."""
    rows = [("x", p, f"Notes of the Third Circuit\n{40 + p}\nThe plea of limitation was urged before the learned judge of the trial\ncourt and was rejected.") for p in (1, 2, 3)]
    rows += [("x", 4, "The plea of limitation was urged before the learned judge of the trial\nNotes of the Third Circuit\ncourt and was rejected by him on the evidence of the attesting witness.")]
    asks = {r.ask for r in FU.learn(spark.createDataFrame(rows, "doc string, page int, text string"), S.CONFUSED)[1].collect()}
    assert asks == {"x|NOTESOFTHETHIRDCIRCUIT", "x|40"}


def test_forms(spark):
    """Digits and bars in words, letters in numbers and marks alone, all by counts."""
    forms = [("district", 900), ("principle", 300), ("the", 9000), ("Zolmine", 30), ("1990", 50), ("2041", 40), ("1022", 40), ("di5trict", 1), ("pr!nciple", 1), ("1O22", 1), ("Zolm0va", 1), ("•", 2), ("52A", 9), ("55th", 3), ("1980s", 4), ("224B", 3)]
    got = {r.form: r.fixed for r in S.misread_forms(spark.createDataFrame(forms, "form string, n long")).collect()}
    assert got == {"di5trict": "district", "pr!nciple": "principle", "1O22": "1022", "Zolm0va": "Zolm0va", "•": ""}


ODD = ["an in-law's pr!nciple\tof\r\nthe law¡", "a•b • c\u00a0• d\u2003\u3000~~", "in-law  in-law-s\nIn-Law 1O22 ¡x |", "", " ", "_ ^^ x²³ 12"]


def test_forms_by_pieces(spark):
    """Words are counted by the distinct pieces between blanks, as if each text had been searched whole."""
    forms = S._forms(spark.createDataFrame([(t,) for t in ODD * 3], "text string"))
    got = {r.form: r.n // 3 for r in forms.collect()}
    want = {"in": 3, "law": 4, "s": 2, "pr!nciple": 1, "of": 1, "the": 1, "an": 1, "a": 1, "b": 1, "c": 1, "d": 1, "•": 1, "In": 1, "Law": 1, "1O22": 1, "¡x": 1, "|": 1, "_": 1, "^^": 1, "x²³": 1, "12": 1, "in-law": 3}
    assert got == want
    plan = forms._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.rindex("Aggregate")  # pieces are made one before the patterns see them


def test_open_words(monkeypatch):
    """What is asked of a text is what its patterns find in the whole of it; a piece met again is not searched again."""
    searched = []

    class Noted:
        def findall(self, text):
            searched.append(text)
            return found(text)

    found = S._TOKEN.findall
    common = frozenset(["law", "the"])
    want = [{x for x in found(t) if x not in common and not x.isdigit()} | set(S._STRAY.findall(t)) for t in ODD]
    monkeypatch.setattr(S, "_TOKEN", Noted())
    words = S.OpenWords(common)
    assert [words.of(t) for t in ODD * 50] == want * 50
    assert len(searched) == len(set(searched)) == len({x for t in ODD for x in t.split()})
    few = S.OpenWords(common, 2)
    assert [few.of(t) for t in ODD * 2] == want * 2 and len(few.settled) + len(few.asking) <= 2


def corpus(spark, extra):
    rows = [(f"c{i}", PLAIN + f" It was recorded on {i} January that the order of the tribunal did not survive.", "x", None, None) for i in range(60)]
    rows += [(f"b{i}", t, "x", d, p) for i, (d, p, t) in enumerate(pages())]
    return spark.createDataFrame(rows + [(*e, None, None) for e in extra], "id string, text string, noise_kind string, judgment_id string, pdf_page int")


def test_found_and_repaired(spark):
    extra = [
        ("h1", "The peti-\ntion discloses no error.", ""),
        ("h2", "The peti­ tion discloses no error.", ""),
        ("h3", "The short-\nterm tenant was examined.", ""),
        ("m1", "The pctition discloses no error.", ""),
        ("m2", "The petition disclosesno error.", ""),
        ("m3", "The petition • discloses no error.", ""),
        ("n1", "THE NORTHERN LAW SERIES  [1983] 12 N.L.S.    41\nThe petition discloses no error.", ""),
        ("ok", "The tenant was examined.", ""),
        ("e1", "", ""),
        ("e2", None, ""),
        (None, "The pctition", ""),
        ("long", "The petition discloses no error. " * 3000 + "The peti-\ntion", ""),
        ("m1", "The pctition discloses no error.", ""),
    ]
    df = corpus(spark, extra)
    cols = ("id", "text", "judgment_id", "pdf_page")
    got = sorted(tuple(r) for r in S.scan_noise(df, *cols).collect() if r.id[0] != "b")
    want = [("h1", "hyphenation"), ("h2", "hyphenation"), ("long", "hyphenation"), ("m1", "misread"), ("m2", "misread"), ("m3", "misread"), ("n1", "header"), ("n1", "page_number")]
    assert got == want
    fixed = {r.id: r.text for r in S.repair_scans(df, *cols).collect()}
    assert all(fixed[k] == "The petition discloses no error." for k in ("h1", "h2", "m1", "m2", "m3", "n1"))
    assert fixed["h3"] == "The short-term tenant was examined." and fixed["e1"] == "" and "e2" not in fixed
    assert fixed["b0"] == "The plea of limitation was urged before the learned judge of the trial court and was rejected by him on the evidence of the attesting witness number 0, who had seen the deed signed."


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert S.scan_noise(df, "id", "text").count() == 0 and S.repair_scans(df, "id", "text").count() == 0
