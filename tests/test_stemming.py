import pytest
from test_entry import test_queries_match_their_sql as matches_sql

from roadweave.operators import stemming, textsim

#: Words and stems of the published description, step by step, and of the departures.
STEMS = """
caresses caress  ponies poni  ties tie  caress caress  cats cat  feed feed  agreed agre  plastered plaster  bled bled  motoring motor  sing sing
conflated conflat  troubled troubl  sized size  hopping hop  tanned tan  falling fall  hissing hiss  fizzed fizz  failing fail  filing file  happy happi
sky sky  relational relat  conditional condit  rational ration  valenci valenc  hesitanci hesit  digitizer digit  conformabli conform  radicalli radic
differentli differ  vileli vile  analogousli analog  vietnamization vietnam  predication predic  operator oper  feudalism feudal  decisiveness decis
hopefulness hope  callousness callous  formaliti formal  sensitiviti sensit  sensibiliti sensibl  triplicate triplic  formative form  formalize formal
electriciti electr  electrical electr  hopeful hope  goodness good  revival reviv  allowance allow  inference infer  airliner airlin  gyroscopic gyroscop
adjustable adjust  defensible defens  irritant irrit  replacement replac  adjustment adjust  dependent depend  adoption adopt  homologou homolog
communism commun  activate activ  angulariti angular  homologous homolog  effective effect  bowdlerize bowdler  probate probat  rate rate  cease ceas
controll control  roll roll  dying die  news news  died die  cried cri  enjoy enjoy  say say  geologi geolog  by by  owed owe  123ing 123ing
""".split()


def test_stems():
    for word, stem in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert stemming.stem(word) == stem, word


def test_arrays_of_words(spark):
    rows = [(1, ["running", "runs", "the", "tied", "running"]), (2, []), (3, None), (4, ["ponies", "", "x9"])]
    df = spark.createDataFrame(rows, "id long, w array<string>").coalesce(1)
    got = {r.id: r.s for r in df.select("id", stemming.stems(df.w).alias("s")).collect()}
    assert got == {1: ["run", "run", "the", "tie", "run"], 2: [], 3: None, 4: ["poni", "", "x9"]}
    assert {r.id: r.s for r in df.where("id > 1").select("id", stemming.stems(df.w).alias("s")).collect()} == {k: got[k] for k in (2, 3, 4)}  # a slice of a batch


def test_rouge_with_and_without_stems(spark):
    rows = [(1, "The cars were passing slowly", "the car was passed slow"), (2, "", "x"), (3, None, "a b"), (4, "same words", "same words")]
    df = spark.createDataFrame(rows, "id long, candidate string, reference string")
    stemmed = {r.id: r.rouge_l for r in textsim.rouge_l(df).collect()}
    plain = {r.id: r.rouge_l for r in textsim.rouge_l(df, stemming=False).collect()}
    assert stemmed == {1: pytest.approx(0.6), 2: 0.0, 3: 0.0, 4: 1.0}  # the car(s) pass; slowli is not slow
    assert plain == {1: pytest.approx(0.2), 2: 0.0, 3: 0.0, 4: 1.0}


@pytest.mark.parametrize("name", ["rouge_l", "evaluation_report", "word_stems"])
def test_queries(spark, name):
    matches_sql(spark, name)
