from pyspark.sql import functions as F

from knotwork.llm.structure import divergence, statistics, _PROFILES

SCHEMA = "doc bigint, text string, key string, profile string"
EN = "The mill near the old bridge was sold in 1809, shortly before the harbour at Yo was closed. Nobody knows why they left; the town kept no records of it. "
PROSE = [
    EN, EN.upper(), EN.replace(".", "").replace(",", ""), "> " + EN, EN.replace(" ", "\n", 60)[:60] + EN, "Der Markt wurde verlassen, weil der Graf dafür 250 Taler gab und niemand mehr in der Stadt blieb.",
    "Chaque année, les gens de la vallée visitent ce quai oublié, qui fut restauré deux fois avant la crue de 1805.", "Cada año la gente del valle visita ese pozo tranquilo, aunque nadie en el pueblo sabe quién lo dejó.",
    "Anna: Did you see the boat?\nPaul: No, it had left before I came to the pier.\n" * 3, "About the mill\n\n" + EN * 3 + "\n* mill\n* pier\n",
]
JUNK = [
    "| a | b | c |\n|---|---|---|\n" + "| Yo | bridge of | Da |\n" * 12, "name,year,place\n" + "Yo,1809,Da\n" * 20, "Yo\t12\tDa\t3.5\n" * 20, "* Yo, Da\n* Wi\n* Ze (moth)\n" * 8, "Home\nNext\nLog in\nTop\nShare\nIndex\n" * 6,
    "Yo ........ 12\nDa ...... 40\n" * 10, "type: Yo\nowner: Da\ncode: Wi\n" * 8, "Yo, C. (1990). Barren yard. Da: Wi Press, p. 348.\n" * 6, '[{"id": "Q1", "n": "Yo"}, {"id": "Q2", "n": "Da"}]' * 6,
    "49 a8 19 95 bf df 91 3c 4c ef b1 f8 38 d0 57 e7\n" * 8, "381 4 47445 53 780358 5456190 8 83 " * 10, "=/^^^=|!*:-<@*+/&=>*^>\\>~=-&__:%#%!+^/ " * 8, "spring, engine, eastern parish, dark treaty, yard, ridge, coin, bell, tower, " * 4,
    "Restored donated tavern broad masons. Rebuilt seasonal ferry enlarged governed. Stone clerks wide. " * 4, EN[:60] + "\n" + "Yo,1809,Da\n" * 60,
]


def test_verdicts(spark):
    texts = PROSE + JUNK
    df = spark.createDataFrame([(i, t, "k", "p") for i, t in enumerate(texts)], SCHEMA)
    share = {r.doc: r.nonprose_share for r in statistics(df, "doc", "text").collect()}
    assert [i for i in range(len(PROSE)) if share[i] > 0.5] == []
    assert [i for i in range(len(JUNK)) if share[len(PROSE) + i] <= 0.5] == []


def test_counts(spark):
    row = statistics(spark.createDataFrame([(1, "Der Hof, 12 Tiere.\n- Ja!", "k", "p")], SCHEMA), "doc", "text").first()
    assert (row.n_chars, row.n_words, row.n_lines) == (24, 5, 2)
    assert row.punctuated_lines == 1.0 and row.bullet_lines == 0.5 and abs(row.mean_word_length - 15 / 5) < 1e-9


def test_null_blank_long_and_empty(spark):
    df = spark.createDataFrame([(1, None, "", ""), (2, " \n ", "", ""), (None, EN * 3000, "", "")], SCHEMA)
    rows = {r.doc: r for r in statistics(df, "doc", "text").collect()}
    assert rows[1].nonprose_share is None and rows[2].profile is None and rows[1].n_words == 0
    assert rows[None].nonprose_share < 0.05
    assert statistics(spark.createDataFrame([], SCHEMA), "doc", "text").where(F.col("n_words") > 0).count() == 0


def test_divergence_bounds():
    js = divergence(_PROFILES, _PROFILES)
    assert abs(js.diagonal()).max() < 1e-12 and js.max() <= 1 and abs(js - js.T).max() < 1e-12
