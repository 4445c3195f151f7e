import pytest

from quern.functions import macros, variants


def shown(spark, source):
    return [r.variant for r in variants.enumerated(spark, macros.parsed(source)).orderBy("seed").collect()]


def test_macro_texts(spark):
    assert shown(spark, "plain (text), PERM_ kept)") == ["plain (text), PERM_ kept)"]
    assert shown(spark, "a / PERM_GENERAL(,(unsigned int),(float)) b") == ["a /  b", "a / (unsigned int) b", "a / (float) b"]
    assert shown(spark, "PERM_GENERAL(1,PERM_GENERAL(f(2,3),4),5)") == ["1", "f(2,3)", "4", "5"]
    assert shown(spark, "PERM_ONCE(a;) b; PERM_ONCE(a;)") == ["a; b; ", " b; a;"]
    assert shown(spark, "PERM_VAR(d,)PERM_GENERAL(s;,PERM_VAR(d, s;)) b;PERM_VAR(d)") == ["s; b;", " b; s;"]
    assert shown(spark, "PERM_INT(-1,1)") == ["-1", "0", "1"]
    assert sorted(shown(spark, "PERM_LINESWAP_TEXT(\na, b\n\nPERM_GENERAL(c,d)\n)")) == ["a, b\nc", "a, b\nd", "c\na, b", "d\na, b"]
    assert shown(spark, "PERM_IGNORE(PERM_GENERAL(,x, y))") == ["", "\n#pragma literal eA==\n", "\n#pragma literal IHk=\n"]
    assert shown(spark, "PERM_RANDOMIZE(a, b)") == ["\n#pragma region randomize\na, b\n#pragma endregion randomize\n"]
    assert shown(spark, "") == [""]


@pytest.mark.parametrize("source", ["PERM_NONE(a)", "PERM_GENERAL(a,(b)", "PERM_INT(1)", "PERM_ONCE(a,b,c)", "PERM_ONCE(a;)"])
def test_wrong_macro_texts(source):
    with pytest.raises(ValueError):
        macros.parsed(source)


def test_variable_that_is_not_set(spark):
    with pytest.raises(ValueError):
        shown(spark, "PERM_VAR(v)")
    with pytest.raises(Exception, match="v is read before it is set"):
        shown(spark, "PERM_GENERAL(a,PERM_VAR(v,b))PERM_VAR(v)")
