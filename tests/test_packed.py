import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from knotwork.operators.packed import explode_packed

CASES = {
    '"Yo| Da"|Charter': ["Yo| Da", "Charter"],
    r"Zag\|Tech|Brou": ["Zag|Tech", "Brou"],
    '"The ""Nis"" clock, public","Dö | Th"': ['The "Nis" clock, public', "Dö | Th"],
    'Old "Tro" Farm|Tog|"SWC"': ['Old "Tro" Farm', "Tog", "SWC"],
    '["Dr\\u00e9m", "Pli/Sia, Skin"]': ["Drém", "Pli/Sia, Skin"],
    '"Fof, Old"': ["Fof, Old"],
    "Stü/Stö": ["Stü/Stö"],
    "TB64; Mö/Zi / Sia": ["TB64", "Mö/Zi", "Sia"],
    "|A||B | | C": ["A", "B", "C"],
    "SD95, Brö,": ["SD95", "Brö"],
    "Paej, Little|Q": ["Paej, Little", "Q"],
    "a\r\nb\nb": ["a", "b", "b"],
    "G｜Krö, Upper；F•H¦I\tJ": ["G", "Krö, Upper", "F", "H", "I", "J"],
    "[not json": ["[not json"],
    "xy|z|0": ["xy", "z", "0"],
    '"unclosed|b': ['"unclosed', "b"],
    "": [],
    " | ;": [],
}


def unpacked(spark, texts):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "rec bigint, f string, alias_pos int")
    out = {i: [] for i in range(len(texts))}
    for r in sorted(explode_packed(df, "rec", "f").collect(), key=lambda r: (r.rec, r.alias_pos)):
        assert r.alias_pos == len(out[r.rec]) + 1
        out[r.rec].append(r.alias_value)
    return list(out.values())


def test_conventions(spark):
    assert unpacked(spark, list(CASES)) == list(CASES.values())


def test_null_and_very_long(spark):
    assert unpacked(spark, [None, "|".join(f"v{i}" for i in range(5000))]) == [[], [f"v{i}" for i in range(5000)]]


VALUE = st.text(st.sampled_from('ab"|;, /\\é'), min_size=1, max_size=8).map(str.strip).filter(lambda v: v and not v.startswith(("[", '"')) and "\\" not in v)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(VALUE, min_size=2, max_size=5), min_size=1, max_size=8))
def test_round_trips(spark, rows):
    quoted = ["|".join('"' + v.replace('"', '""') + '"' for v in row) for row in rows]
    listed = [json.dumps(row) for row in rows]
    assert unpacked(spark, quoted) == rows
    assert unpacked(spark, listed) == rows
