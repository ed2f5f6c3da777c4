import random

from knotwork.llm.residue import paths, residue, templates, without_residue

SCHEMA = "rec bigint, descr string, key string, segment string"
BAD = {
    "{{name}} is a town.": ["slot"], "canal from <<page-title>>": ["slot"], "known for %(item.desc)s": ["slot"], "[insert region here]": ["slot"], "See also (label goes here).": ["slot"], "&LT;CITY&GT; IS A TOWN": ["slot"], "SEE ALSO (LABEL  GOES HERE).": ["slot"],
    "Lorem ipsum dolor sit amet consectetur adipiscing elit.": ["filler"], "bla bla bla": ["message"], "xxxx xxx xxxxx": ["message"],
    "Error 404: Not Found": ["message"], "Read timed out.": ["message"], "408 - Not Found - ray 984add3f": ["message"], "Bad request (401) Erreur 500 : page introuvable": ["message"], "A quiet town. Access to this resource is restricted.": ["message"], "Seite nicht gefunden": ["message"],
    "Please enable JavaScript to continue.": ["message"], "BITTE AKTIVIEREN SIE JAVASCRIPT, UM FORTZUFAHREN.": ["message"], "We use cookies. Accept all to read on.": ["message"],
    "TODO: write a summary of Yobe": ["message"], "Texte à compléter": ["message"], "<p>Beschreibung folgt in Kürze</p>": ["message"],
}
GOOD = [
    "Not found 1984 in the old mill, it hangs at Yo.", "Forbidden 3 times, the play opened at Jo in 1560.",
    "Error 500, a play by Glal Lis, opened at Jo in 1560.", "Its third song is called Access Denied.", "Blah is a village of 704 people.", "Coming Soon is a novel by Bia Sti.", "a cookie brand from Yas",
    "File format that writes values as <217> or {54}.", "According to [P34.E5], it had 3 ships<ref>97</ref>.", "[[charter]] and former port", "In Yes notation, it is the set {6, 17}.", "written <Diapa Bay> in old letters",
    "species&nbsp;of lichen", "a typeface whose specimens show lorem ipsum in 35 sizes", "closed for maintenance since 1718", "", "   ", None,
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in enumerate(texts)], SCHEMA)
    return {r.rec: r.kinds for r in residue(df, "rec", "descr").collect()}


def test_residue_is_found(spark):
    assert found(spark, list(BAD)) == dict(enumerate(BAD.values()))


def test_true_descriptions_stay(spark):
    assert found(spark, GOOD) == {}


def test_templates_carry_verdicts_to_all_their_segments(spark):
    texts = [f"Sample description number {i}" for i in range(30)] + [f"The mill near Yo {i} closed in 18{i % 90 + 10}." for i in range(30)]
    assert set(found(spark, texts)) == set(range(30))


def test_exclusion_keeps_the_rest_and_null_keys(spark):
    df = spark.createDataFrame([(1, "bla bla bla", "a", "b"), (2, "a town", "a", "b"), (2, "a town", "a", "b"), (None, "a town", "a", "b")], SCHEMA)
    assert sorted(r.rec or 0 for r in without_residue(df, "rec", "descr").collect()) == [0, 2, 2]


def test_empty_and_very_long(spark):
    assert found(spark, []) == {}
    assert found(spark, ["A quiet town. " * 20000 + "Read timed out."]) == {0: ["message"]}


def test_other_rows_change_no_verdict(spark):
    alone = ["One moment please we are now verifying on the town", "Just a moment while we are verifying your connection", "Sample description number 7"]
    ordinary = ["One moment please we are now zooming on the town", "One moment please we are now acting on the town", "Just a moment while we are crossing your river", "Sample barley number 7"]
    assert found(spark, alone) == dict.fromkeys(range(3), ["message"])
    rng = random.Random(3)
    words = ["One", "moment", "mill", "river", "we", "are", "now", "near", "Just", "a", "while", "stone", "Sample", "7"]
    crowd = alone + ordinary + [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 11))) for _ in range(300)]
    assert {k for k in found(spark, crowd) if k < 3} == {0, 1, 2}


def test_all_segments_of_a_template_share_its_verdict(spark):
    texts = [f"The mill near {place} kept the {thing} of the old town." for place in ("Yo", "Ka") for thing in ("bell", "boat")] + ["Please reload this page of the site."] * 3
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.template: (r.n_segments, r.verdict) for r in templates(paths(df, "rec", "descr")).collect()}
    assert sorted(rows.values(), key=str) == [(2, None), (2, None), (3, "message")]


def test_own_name_is_no_content(spark):
    rows = [(1, "Welcome to the page of Old Mill of Yobe!", "Old Mill of  Yobe", "s"), (2, "Old Mill of Yobe is a mill.", "Old Mill of Yobe", "s"), (3, "Fixme no summary for Yobe", None, "s"), (4, "Yobe, written <Tivo> in old letters, is a town", "x", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.rec for r in residue(df, "rec", "descr", "key").collect()} == {1, 3}


def test_ten_times_the_rows_give_the_same_share(spark):
    texts = list(BAD) + GOOD
    assert set(found(spark, texts * 10)) == {i for i in range(10 * len(texts)) if i % len(texts) < len(BAD)}
