import random

from hindcast.llm.names import fits_organisation, fits_person, jaro_winkler, linked_speakers, one_slip, nearness, phonetic, reference_keys, similar, speaker_groups, spelling


def test_parts():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert one_slip("volarcott", "volracott") and one_slip("abc", "abcd") and not one_slip("abcd", "badc")
    assert similar("alexander", "aleksander") and similar("johansson", "johannson") and nearness("volarcott", "volracott") == 1 and nearness("peskesrell", "prskesrell") == 1
    assert not similar("breanphine", "breorphine") and not similar("vera", "mina") and not similar("abc", "abd")
    assert phonetic("volracott") == phonetic("volarcott")
    assert fits_person(spelling("Rita Dovalund"), "Rosemira Dovalund", "minister", "")[0] == 0
    assert fits_person(spelling("Mina Talvane"), "Vera Talvane", "minister", "")[0] == 0


def test_a_slip_leaves_a_key():
    rng = random.Random(4)
    for form, name in [("O. Ossefoss", "Oskilphine Ossedoss"), ("V. Volalik", "Veri Volanlik"), ("I. Sukesfax", "Iorildan Sulesfax"), ("S. Sukasky", "Sabara Sulasky"), ("R. Dremunmpnt", "Rosulis Dremunmont"), ("O. Ossoray", "Oskorven Ossobray")]:
        assert fits_person(spelling(form), name, "", "")[0] and spelling(form).keys() & reference_keys(name, "person", "")
    for form, name in [("Agency of Housing Integrarion", "Agency of Housing Integration"), ("Rail Kouncil", "Rail Council"), ("Mazr Council", "Maze Council")]:
        assert fits_organisation(spelling(form), name, "") and spelling(form).keys() & reference_keys(name, "organisation", "")
    tried = 0
    while tried < 500:
        last = "".join(rng.choice("abdefgklmnorstvy") for _ in range(rng.randint(2, 9)))
        at, how = rng.randrange(len(last)), rng.randrange(4)
        typed = last[:at] + ("", rng.choice("aklmnt"), rng.choice("aklmnt") + last[at], last[at + 1 : at + 2] + last[at])[how] + last[at + (2 if how == 3 else 1) :]
        if similar(typed, last):
            tried += 1
            for form in (f"M. {typed}", f"Minister {typed}", f"{typed}, M."):
                assert spelling(form).keys() & reference_keys(f"Mina {last}", "person", ""), (form, last)


ACTORS = [
    ("lem", "Lemusgor Volarcott", "person", "Chancellor", ["Lemek"]), ("pel", "Pelorra Oskorven Brunenard", "person", "Senator", []), ("aldi", "Aldisio Firthozek", "person", "Minister", []),
    ("alde", "Aldenmund Firthozek", "person", "General", None), ("ctt", "Council of Tea Turnout", "organisation", "Council", ["CTT"]), ("smc", "Steddenstad Maize Commission", "organisation", "Commission", []),
]
LINKED = {
    "lemusgor volarcott": "lem", "LEMUSGOR_VOLARCOTT": "lem", "Volarcott, L.": "lem", "Chancellor Volarcott": "lem", "Lemusgor Volracott": "lem", 'Lemusgor "Moss" Volarcott': "lem", "Moss Volarcott": "lem", "Volarcott (Lemek)": "lem",
    "LemusgorVolarcott": "lem", "Volarcott Lemusgor, spokesperson": "lem", "Pelorra Brunenard": "pel", "Sen. Pelora Brunenard": "pel", "Pelorra O. Brunenard": "pel", "the Council of Tea Turnout": "ctt", "C.T.T.": "ctt",
    "Cpuncil of Tea Turnout": "ctt", "Tea Turnout Council": "ctt", "Steddenstad Maize Comm.": "smc", "Minister Firthozek": "aldi", "Aldenmund Firthozke": "alde",
}
NOBODY = ["", " ", None, "Unknown", "a senior official", "Wimorsio Volarcott", "Zelavphine Brunenard", "Lemusgor Volarcott", "Council of Rail Access", "A. Firthozek"]


def test_links(spark):
    people = spark.createDataFrame(ACTORS, "actor_id string, name string, kind string, role string, known_as array<string>").selectExpr("*", "1 as form")
    speakers = [*LINKED, *NOBODY]
    quotes = [(s, "q", "c") for s in speakers]
    rows = [("r1", ["lem"], quotes), ("r1", ["lem"], quotes), ("r2", ["alde", "x"], [("A. Firthozek", "q", "c"), None]), ("r3", None, None), (None, ["lem"], [("L. Volarcott", "q", "c")])]
    events = spark.createDataFrame(rows, "record_id string, actors array<string>, direct_quotes array<struct<speaker string, quote string, context string>>").selectExpr("*", "1 as fit")
    got = {(r.record_id, r.quote_no): r.actor_id for r in linked_speakers(events, people).collect()}
    assert got == {("r1", i): LINKED[s] for i, s in enumerate(speakers) if s in LINKED} | {("r2", 0): "alde"}
    assert linked_speakers(events.limit(0), people).count() == 0
    assert linked_speakers(events, people.limit(0)).count() == 0


def test_spellings_link_spellings(spark):
    people = spark.createDataFrame(ACTORS, "actor_id string, name string, kind string, role string, known_as array<string>")
    outsider = ["Alexander Stormquist", "Aleksander Stormquist", "A. Stormquist", "Stormquist, Alexander", "ALEXANDER STORMQVIST"]
    chain = ["Lemusgor Volracott", "Lemusgro Volracott", "Lemusgro Volracot"]
    other = ["Zelavphine Brunenard", "Zelavphine Brunennard", "Mina Brunenard", "M. Ostergaard", "Mina Ostergaard", "Marta Ostergaard"]
    quotes = [(f, "q", "c") for f in outsider + chain + other]
    events = spark.createDataFrame([("r", ["lem"], quotes), ("s", None, quotes)], "record_id string, actors array<string>, direct_quotes array<struct<speaker string, quote string, context string>>")
    rows = speaker_groups(events, people).collect()
    got = {r.form: (r.group_id, r.actor_id) for r in rows}
    assert len(rows) == len(got)
    assert {got[f] for f in outsider} == {(min(outsider), None)}
    assert {got[f] for f in chain} == {("lem", "lem")}
    assert got["Zelavphine Brunenard"] == got["Zelavphine Brunennard"] == ("Zelavphine Brunenard", None)
    assert "M. Ostergaard" not in got and "Mina Brunenard" not in got
    assert speaker_groups(events.limit(0), people).count() == 0
