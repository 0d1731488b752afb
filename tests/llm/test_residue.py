import pytest

from mentionloom.llm import residue as R

GOOD = "The infant showed mild spasm after 3 weeks. Twin B walked at 12 months."
# what a page says by its form alone, whatever else the table holds
FORMS = [
    ("404 Not Found", True), ("HTTP Error 503: the service is down for upkeep. Try again later.", True), ('{"error": {"status": 401, "reason": "unauthorized"}}', True), ("<h1>410</h1><p>Gone</p>", True), ('{"error": "' + "x" * 600 + '"}', True),
    ("blah blah blah blah blah blah", True), ("测试文字测试文字测试文字测试文字", True), ("qwerty qwerty qwerty", True), ("aaa bbb ccc ddd", True), (GOOD * 5000 + "\n502 Bad Gateway", True),
    (GOOD, False), ("Crawls of registry 77 that ended in HTTP error 503 were repeated.", False), ("Of 266 families screened, 404 were not found again.", False), ("Error 500 m from the target line was the mean.", False), ("ACGT" * 12, False), ("1234567890" * 4, False), ("7 7 7 7 7 cm", False),
    ("Seen for 2 weeks. Seen for 3 weeks. Seen for 4 weeks.", False), (GOOD * 5000, False), (None, False), ("", False), (" \n ", False),
]
# markers of one name in three templates each, in all styles; what is no marker or only mentioned
SLOTS = [
    ("Written consent ({{ consent.ref }}) is on file.", True), ("Written consent (${gene}) is on file.", True), ("Serum values were [INSERT GENE] on day [INSERT CONSENT.REF].", True), ("Serum values were <gene> on day %consent_ref%.", True),
    ("Dear Dr ____________ (gene), we report on XXXX-XX-XX.", True), ("Dear Dr <<gene>>, we report on [[consent.ref]].", True), ("Admitted on DD-MM-YYYY.", True), ("Admitted on YYYY-MM-DD.", True), ("At the age of [completar aquí] months", True), ("At the age of {{gene}} months", True),
    ('Blank cells had been exported as "{{consent.ref}}" by the tool.', False), ("Values below 3 are shown as <LOD> and missing ones as [n/a].", False), ("Sets are written {a, b, c} throughout.", False), ("Gaps are marked as ____ on sheet 4.", False), (GOOD, False),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n string")


def found(spark, texts, **options):
    return {r["doc_id"] for r in R.find_residue(frame(spark, texts), **options).collect()}


def test_forms(spark):
    assert found(spark, [t for t, _ in FORMS]) == {i for i, (_, r) in enumerate(FORMS) if r}


def test_slots_of_aligned_units(spark):
    assert found(spark, [t for t, _ in SLOTS]) == {i for i, (_, r) in enumerate(SLOTS) if r}
    assert found(spark, ["A unit of its own with {{marker}} alone."]) == set()


def test_learned_names_and_filler(spark):
    latin = ["lorem", "ipsum", "sitra", "ametur", "vitae", "orcan", "elitra"]
    docs = [(i, " ".join(latin[(i + k) % 7] for k in range(12)) + ".") for i in range(20)]
    docs += [(100 + i, f"Seen at {a} in {b}.") for i, (a, b) in enumerate([("{{hospital}}", "{{gene}}"), ("${gene}", "<hospital>"), ("<gene>", "%hospital%"), ("Bonn", "May")])]
    docs += [(200 + i, f"Drug {a} was kept by {b}.") for i, (a, b) in enumerate([("{{gene}}", "{{hospital}}"), ("${hospital}", "@@gene@@"), ("<hospital>", "us")])]
    docs += [(300, "Sitra vitae orcan elitra ametur orcan."), (301, "Levels of <LOD> in {a, b} are plain."), (302, GOOD), (303, None), (302, GOOD)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, n string")
    names = {r["name"] for r in R.variable_names(R.evidence(df)).collect()}
    assert names == {"gene", "hospital"}
    assert {r[0] for r in R.find_residue(df).collect()} == {*range(20), 100, 101, 102, 200, 201, 202, 300}
    assert sorted(r["doc_id"] for r in R.without_residue(df).collect()) == [103, 301, 302, 302, 303]
    assert R.find_residue(df.limit(0)).count() == 0


MESSAGES = [
    "Please enable JavaScript to view this article.", "Sorry, the passage viewer is not available to you. Ticket {i}.", "Titel des Fallberichts hier eingeben", "Pagina non trovata. Codice {i}", "页面不存在，请返回首页。",
    "Too many requests from your address. Please wait {i} seconds.",
]


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_repeated_pages(spark, block):
    """Messages of no listed form, of any length and language, are known by the pages that they make."""
    pages = [m.replace("{i}", str(i)) for i in range(3) for m in MESSAGES] + [f"{m.replace('{i}', '77')}\nHome" for m in MESSAGES]
    cut_off = [f"{GOOD}\n" * 6 + "It was see...\n" + m.replace("{i}", "99") for m in MESSAGES]
    plain = [f"{GOOD}\n" * 6 + f"Case {i}. The portal asked {i} parents to enable JavaScript, which 5 found hard. \"Access denied\" was the commonest complaint." for i in range(4)]
    plain += [f"Male {i} had a mild tremor at rest." for i in range(6)] + [f"{GOOD}\n" * 6 + f"Male {i} had a mild tremor at rest." for i in range(12)] + ["A page that was copied."] * 4
    got = found(spark, [*pages, *cut_off, *plain], block=block)
    assert got == set(range(len(pages) + len(cut_off)))


def test_blocks_of_any_size_find_the_same(spark):
    """Units that barely have their share of pairs or filler, and units that barely lack it, however the learned numbers fall into blocks and the rows into batches."""
    words = [[f"w{k}{chr(97 + i)}{chr(97 + i)}" for i in range(11)] for k in "abcdefghij"]
    latin = ["lorem", "ipsum", "sitra", "ametur", "vitae", "orcan", "elitra", "dolent", "ullam", "quist"]
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    rows, case = [], set()

    def put(text, is_case):
        rows.append((len(rows), text))
        if is_case:
            case.add(len(rows) - 1)

    for k in range(10):
        for i in range(4):
            put(" ".join([*words[k], f"teach{letters(k)}x{letters(i)}"]), True)
    for i in range(20):
        put(" ".join(latin[(i + j) % 10] for j in range(12)) + ".", True)
    for k in range(10):
        for has in (7, 8):  # pairs of 12: seven are too few
            own = [f"own{letters(len(rows))}x{letters(i)}" for i in range(12 - has)]
            put(f"{GOOD}\n" * 6 + " ".join([*words[k][: has + 1], *own]), has == 8)
    for k in range(10):
        for has in (6, 7):  # words of 10: six are too few
            put(f"{GOOD}\n" * 6 + " ".join([*(latin[2:] * 3)[k : k + has], *(f"own{letters(len(rows))}x{letters(i)}" for i in range(10 - has))]), has == 7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (1_000_000, 60, 23, 7):
        got = {r[0] for r in R.find_residue(df.repartition(3), block=block).collect()}
        assert (block, got - case, case - got) == (block, set(), set())


def test_long_messages(spark):
    long = "The reader could not open what you asked for " + "and tried again " * 40
    teach = [f"The reader could not open what you asked for and tried again {w}" for w in ("", "and again", "and tried again", "and tried again now")]
    assert found(spark, [*teach, f"{GOOD}\n" * 6 + long]) == {0, 1, 2, 3, 4} and len(long) > 400


def test_pages_of_one_short_line(spark):
    assert found(spark, [*[f"Test {i}" for i in range(5)], *["Results"] * 5, *[f"Results\n{GOOD}"] * 5, "Word"]) == set(range(5))


def test_blanks(spark):
    assert found(spark, ["Seen by {{doctor}} in May.", "Seen by ${nurse} in May.", "Seen by ____ in May.", "Gaps are marked as ____ on sheet 4."]) == {0, 1, 2}
