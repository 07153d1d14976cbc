from pyspark.sql import functions as F

from planloom.llm.plans import p6_found
from planloom.llm.residue import line_runs, residue_records

BAD = [
    "{{ job number }}", "${title}", "<<proj_no>>", "«project name»", "@@JobNo@@", "%%title%%", "$title$", "__project_title__", "[enter rpoject name]", "Grilkewy High [SITE NAME] HVAC", "{0} Hall Boiler", "${year} Hall", "<phase> Kitchen", "(insert phase) Roof", "%NAME% Clinic",
    "XXXXX.XX", "Bauxfick XXXX Controls", "xxx xx xxxx", "......................", "_____.__", "[                ]", "?????", "#####.##", "YYMMDD-##", "<yr>.02", "[##].01", "null", "NaN", "(null)", "undefined undefined", "[object Object]", "#N/A", "#VALUE!", "Lorem ipsum dolor", "Doolor sit amet", "asdf asdf",
    "Sample etxt", "Texto de ejemplo", "Placeeholder", "INSERT porj.title", "Typej ob number here", "Choose an tiem.", "Click or tap here to enter text.", "404 - Page ont found", "401 Unauthorizd", "HTTP 502 Bad Gateway", "Access denide", "Sorry, the plan room has expired", "Página no encontrada", "Your sesion has expired. Please sign in again.",
    "Enable JS and cookies to continue", "Switc hon scripts before you sign in", "Permit JavaScriptand reload", "Votre navigateur blqoue les scripts", "You need to turn on JavaScript to run this app.",
]
GOOD = [
    "Building [C] HVAC Replacement", "Title IX Locker Room Upgrade", "404 Boalkstiden Court Reroof", "Crexpoter Script Hall Renovation", "Boalknylen Insert Duct Liner Renewal", "Breindriston Sample Prep Lab Exhaust", "Cartyter Hall <E> RTU Replacement", "Access Road and Bomgund Gym HVAC",
    "Page Street Modernization", "Forbidden Garden Trust", "Template Press LLC", "[Draurfaden] Collective", "Service Authority", "Chalkvuden HS - Bldg {A} Boilers", "22-HV-108", "[23073.02]", "N544/A", "#23531", "24633.0A", "00231.00", "(N) Chiller at Annex", "Default Peak Land Co.", "Blank & Broaxsheden Properties", "", "  ",
]


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc string, field string, value string, _line string")
    return sorted(r["doc"] for r in residue_records(df, ["doc"], "field", "value").collect())


def test_bad_and_good(spark):
    rows = [(f"b{i:02}", "f", v, "mine") for i, v in enumerate(BAD)] + [(f"g{i:02}", "f", v, "mine") for i, v in enumerate(GOOD)] + [("n", "f", None, ""), ("h", None, "{{x}}", "")]
    assert found(spark, rows) == sorted([f"b{i:02}" for i in range(len(BAD))] + ["h"])


def test_repeats_and_empty(spark):
    assert found(spark, [("a", "f", "null", ""), ("a", "f", "null", "")]) == ["a"]
    assert found(spark, []) == []


def test_boilerplate_of_a_host_is_set_aside(spark):
    banner = "Please enable JavaScript to view this page"
    rows = [(f"r{i}", "site", f"{banner}\nReal text number {i} of this record", "") for i in range(40)]
    rows += [("only", "site", banner, ""), ("both", "site", f"{banner}\n404 - Page not found", ""), ("other", "elsewhere", f"{banner}\nReal text", ""), ("long", "site", "word " * 50_000 + "\n#REF!", "")]
    assert found(spark, rows) == ["both", "long", "only", "other"]


def test_residue_that_spread_over_a_field_is_found(spark, tmp_path):
    rows = [(f"d{i:02}", f"404 - Page not found\nRef. {i} of the plan room", "Acme Hall\nBlock A", f"22-HV-{i}") for i in range(40)] + [(f"e{i:02}", f"Hall {i}", None, "null") for i in range(60)]
    spark.createDataFrame(rows, "doc_id string, project_title string, client string, job_number string").write.parquet(f"{tmp_path}/requirement.parquet")
    got = sorted(tuple(r) for r in p6_found(spark, str(tmp_path)).collect())
    assert got == [(f"d{i:02}", "project_title") for i in range(40)] + [(f"e{i:02}", "job_number") for i in range(60)]


def test_evidence_that_boilerplate_or_a_line_break_parts_is_found(spark, tmp_path):
    form = "Bid form of the district"
    titles = [(f"f{i:02}", f"{form}\nHall {i}") for i in range(40)] + [("parted", f"Click or tap here\n{form}\nto enter txet."), ("whole", form), ("mark", f"Hall {{{{ job\n{form}\nnumber }}}}"), ("broken", "Hall 7\nYour session has\nexpired")]
    titles += [(f"s{i:02}", f"Choose\nan item.\nRef. {i}") for i in range(30)] + [("g1", "404\nBoalkstiden Court Reroof"), ("g2", f"Page\n{form}\nStreet Modernization"), ("g3", f"{form}\n---\n"), ("g4", "\n")]
    titles += [(f"t{i:02}", f"Your session has\n{form}\nexpired") for i in range(30)] + [(f"u{i:02}", f"Hall <<job\n{form}\nno>>\nRef. {i}") for i in range(30)]
    rows = [(doc, title, "Acme Hall\nBlock A", None) for doc, title in titles]
    spark.createDataFrame(rows, "doc_id string, project_title string, client string, job_number string").write.parquet(f"{tmp_path}/requirement.parquet")
    got = sorted(tuple(r) for r in p6_found(spark, str(tmp_path)).collect())
    assert got == sorted((doc, "project_title") for doc in ["parted", "mark", "broken", *(f"{x}{i:02}" for x in "stu" for i in range(30))])


def test_broken_boilerplate_of_a_host_is_set_aside(spark):
    banner = "Please enable\nJavaScript"
    rows = [(f"r{i}", "site", f"{banner}\nReal text number {i} of this record", "") for i in range(40)]
    rows += [("only", "site", banner, ""), ("twice", "site", banner, ""), ("both", "site", f"Page not\n{banner}\nfuond", ""), ("other", "elsewhere", f"{banner}\nReal text", "")]
    assert found(spark, rows) == ["both", "only", "other", "twice"]


def test_runs_of_lines(spark):
    made = spark.sql("SELECT array('ab', 'c', 'defg', 'h') AS a, array('ab') AS b, cast(array() AS array<string>) AS c").select(*[line_runs(F.col(x), F.lit(6)).alias(x) for x in "abc"]).first()
    assert [sorted(x) for x in made] == [["abc", "cdefg", "cdefgh", "defgh"], [], []]
