import pytest

from tickloom.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    return toxicity.fit(read("documents"), read("labels"))


@pytest.mark.parametrize("token", ["5h17", "1d107", "w0r7h1355", "1070", "iddiot", "cloown", "£o53r", "1d!07!"])
def test_a_lattice_for_every_token_with_a_sign_or_a_doubled_letter(token):
    assert any(len(p) >= len(token) - 1 for p in toxicity.obfuscated(token))


@pytest.mark.parametrize("run, signs", [
    ("s c u m.", "scum"), ("(s c u m)", "scum"), ("i.d.i.o.t.", "idiot"), ("i-d-i-o-t, yes", "idiot"), ("a s s", "ass"), ("i d i o t!", "idiot"),
    ("_i_d_i_o_t_", "idiot"), ("so 1 d ! 0 t", "1d!0t"), ("x y zebra", None), ("ab c d", None),
])
def test_spaced_runs(run, signs):
    found = ["".join(c for c in m[0] if c not in " .-_*") for m in toxicity._SPACED.finditer(run)]
    assert found == ([signs] if signs else [])


def test_hidden_words_score_as_toxic_and_numbers_do_not(fitted):
    clean = "the thing is of that and for ontion ther "
    hidden = ["1d107", "w0r7h1355", "iddiot", "cloown", "s c u m.", "(s c u m)", "i.d.i.o.t.", "i-d-i-o-t, yes", "i d i o t!", "1 d 1 0 t"]
    found = toxicity._scores(fitted, [f"{clean}{h} {clean}" for h in hidden])
    assert (found >= 0.5).mean() >= 0.75, dict(zip(hidden, found))
    numbers = " ".join(str(7919 * i) for i in range(2000)) + " 2024-01-31 +49 170 1234567 £5 €100 1 2 3 a b c e.g. a 3.14 0x5f3759df 10:45"
    assert toxicity._scores(fitted, [numbers])[0] < 0.5
