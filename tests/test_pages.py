from pyspark.sql import functions as F

from sparkloom.operators import extract as X
from sparkloom.operators import html as H


def test_page_text():
    page = "<nav>skip</nav><main>Keep <b>this</b> content<p>about</p><script>var t='</p>'</script> the disease.</main><footer>x</footer>"
    assert H.page_text(page) == "Keep this content\nabout\nthe disease."
    assert H.page_text("<body><div id='section-body'>a&amp;b<!-- c --></div>z</body>") == "a&b"
    assert H.page_text("<body>only<aside>no</aside></body>") == "only"
    assert H.page_text("plain") == "" and H.page_text("") == "" and H.page_text(None) == ""


def test_titled_sections():
    f = H.titled_sections
    assert f("intro\nCauses\nA\n\nCAUSES\nB") == [("Causes", "A"), ("Causes", "B")]
    assert f("Causes\nCauses\nA") == [("Causes", "Causes\nA")]
    assert f("x\nSymptoms") == []
    assert f("Causes of X\nfoo") == [("General", "Causes of X\nfoo")]
    assert f("") == [("General", "")] and f(None) == [("General", "")]


def test_bullets_lead():
    assert X.lead_bullets("- Alcohol\n- Avoid it.") == "- Alcohol: Avoid it."
    assert X.lead_bullets("- a.\n- b\n- c\ntext") == "- a.\n- b: c\ntext"


def words(n):
    return " ".join(["w"] * n)


def test_merge_short():
    sizes = lambda out: {k: len(v.split()) for k, v in out.items()}
    assert sizes(X.merge_short({"[A]": words(50), "[B]": words(20), "[C]": words(60)})) == {"[A]": 71, "[C]": 60}
    assert sizes(X.merge_short({"[A]": words(60), "[B]": words(20), "[C]": words(50)})) == {"[A]": 60, "[C]": 71}
    assert sizes(X.merge_short({"[A]": words(50), "[B]": words(20), "[C]": words(50)})) == {"[A]": 71, "[C]": 50}
    assert sizes(X.merge_short({"[A]": words(30)})) == {"[A]": 30}
    assert sizes(X.merge_short({"[A]": words(30), "[B]": words(20)})) == {"[B]": 51}
    assert X.merge_short({"[A]": words(9)}) == {}


def test_site_rules():
    text = words(60)
    page = f"<body><h2>About it</h2><p>{text}</p><h2>Clinical Trials</h2><p>{text}</p><h2>After</h2><p>{text}</p></body>"
    assert list(X.extract_sections(page, "www.niddk.nih.gov")) == ["ABOUT IT"]
    assert list(X.extract_sections(page, "elsewhere.org")) == ["ABOUT IT", "CLINICAL TRIALS", "AFTER"]
    cancer = f"<body><h2>Risks</h2><p>{text}</p><p>Learn more about x</p><ul><li>one</li><li>two</li></ul><h2>To Learn More</h2><p>{text}</p></body>"
    assert X.extract_sections(cancer, "www.cancer.gov") == {"RISKS": f"{text}\n- one\n- two"}
    cdc = f"<body><h2>Explore</h2><p>{text}</p><h2>Basics</h2><p>{text}</p><p>Page last reviewed: today</p></body>"
    assert X.extract_sections(cdc, "www.cdc.gov") == {"BASICS": text}


def test_ninds_headings_and_addresses():
    page = "<body><h2>What is it?</h2><p>Short.</p><h2>Table of contents</h2><h2>Is there help?</h2><p>Yes.</p><div><p>Suite 100</p><p>gone</p></div><h2>What research is being done?</h2><p>No.</p></body>"
    assert X.extract_sections(page, "www.ninds.nih.gov") == {"WHAT IS IT?": "Short.", "IS THERE HELP?": "Yes."}


def test_gard_panels_and_symptoms():
    body = words(20) + "."
    page = (
        "<body><div id='MainContent'><p>" + body + "</p><div class='panel'><h2 class='panel-title'>SummarySummary</h2><div class='panel-collapse'>Listen " + body + "</div></div>"
        "<div class='panel'><h2 class='panel-title'>Organizations</h2><div class='panel-collapse'>x</div></div></div></body>"
    )
    out = X.extract_sections(page, "rarediseases.info.nih.gov")
    assert out["SUMMARY"] == body and "ORGANIZATIONS" not in out and body in out["DESCRIPTION"]
    page = f"<body><div id='MainContent'><div><h2>About</h2><p>{words(50)}</p></div><div class='list-item'><h4>Fever</h4><div class='col-5'><p>Synonym: heat</p><p>{words(6)}</p></div></div></div></body>"
    out = X.extract_sections(page, "rarediseases.info.nih.gov")
    assert out["SYMPTOMS"] == f"FEVER:\nSynonyms: heat\n{words(6)}" and "ABOUT" in out


def test_page_without_blocks_and_empty():
    assert X.extract_sections("", "x") == {} and X.extract_sections(None, None) == {}
    assert X.extract_sections("<body></body>", "x") == {"[CONTENT]": ""}


def test_columns(spark):
    rows = spark.createDataFrame([("<body><h1>T</h1><p>" + words(45) + "</p></body>", "x"), (None, None)], "html string, domain string")
    got = rows.select(X.extract(F.col("html"), F.col("domain")).alias("x"), H.html_to_text(F.col("html")).alias("t"), H.parse_sections(F.col("html")).alias("s")).collect()
    assert got[0]["x"]["status"] == "ok" and got[0]["x"]["sections"][0]["section"] == "T"
    assert got[1]["x"]["status"] == "empty" and got[1]["t"] == "" and got[1]["s"][0]["section"] == "General"
