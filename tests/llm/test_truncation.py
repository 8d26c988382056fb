import random

from hindcast.llm.truncation import lost, open_object, truncated, truncation_share

SUBJECTS = ["The window is short, and {} measures usually take {} weeks to publish", "Markets for {} priced in a fee of roughly {} percent", "Pressure from {} raises the chance of a change within {} days"]
NOUNS = [f"{a}{b}" for a in ("coal", "rail", "wool", "salt", "wheat", "steel", "paper", "glass") for b in ("", "works", "yards", "makers")]


def sentence(rng):
    return rng.choice(SUBJECTS).format(rng.choice(NOUNS), rng.randint(10, 99))


def test_structure():
    assert open_object('{"a": "b') and open_object('{"a": [1, 2') and not open_object('{"a": "}\\""}') and not open_object("plain")
    for text in ('{"reasoning": "whole."', "```json\n{}", "cut…", "cut...", "In one phrase: “stat", "one two \\u00", "ends with blank ", "Text <b>bold", "Text <a href='x", "<div>Whole.", "CafÃ© in ParÃ", "Code: ```x", "Cut &#12"):
        assert lost(text)[0], text
    for text in ('{"reasoning": "whole.", "p": 1}', "```json\n{}\n```", "Whole.", "Whole.\n\n", "A slip [sic inside a text.", "In one phrase: “status quo”", "<div>a<br>b</div>", "1 < 2 and 3 > 2.", "Café", "<p>One.", '{"a": "YES", "note": "All is said."}'):
        assert not lost(text)[0], text


def test_cut_and_whole(spark):
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(900):
        text = ". ".join(sentence(rng) for _ in range(4))
        kind = i % 6
        if kind == 0:
            text = text[: rng.randint(60, len(text) - 30)]
            while text[-1] in " ." or text.endswith(("publish", "percent", "days")) or text[-1].isdigit():
                text = text[:-1]
            cut.add(i)
        elif kind < 5:
            text += "."
        rows.append(("f", i, "m", text))
    rows += [("f", 5000, "m", None), ("f", 5001, "m", ""), ("f", 5002, "m", "N/A"), ("f", 5003, None, "No data"), ("f", 1, "m", rows[1][3]), ("f", 5004, "m", "x. " * 50000 + "Whole.")]
    df = spark.createDataFrame(rows, "field string, row_id long, source string, text string").selectExpr("*", "1 as cut", "2 as key")
    out = truncated(df)
    marked = out.collect()
    found = {r.row_id for r in marked if r.cut}
    assert len(marked) == len({r.row_id for r in marked})
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.02 * len(cut)
    assert not found & {5000, 5001, 5002, 5003, 5004}
    total = {(r.field, r.source): r.n_texts for r in truncation_share(out).collect()}
    assert total[("f", "m")] == 902 and total[("f", None)] == 1
    assert truncated(df.limit(0)).count() == 0


def test_limit_of_a_source(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(3000):
        text = ". ".join(sentence(rng) for _ in range(4))
        source = ("limited", "free")[i % 2]
        if i % 3 == 0:
            text = text.rstrip(".")
        else:
            text += "."
        if source == "limited" and len(text) > 230:
            text = text[:230]
            if not text.endswith("."):
                cut.add(i)
        rows.append(("f", i, source, text))
    marked = truncated(spark.createDataFrame(rows, "field string, row_id long, source string, text string"))
    found = {r.row_id for r in marked.collect() if r.cut}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.01 * len(cut)
    shares = {r.source: r.share for r in truncation_share(marked).collect()}
    assert shares["limited"] > 0.5 and shares["free"] < 0.01
