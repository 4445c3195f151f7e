import math
import re

import pytest

from quern.llm import toxicity

LEXICON = {"idiot": 3.0, "stupi*": 2.0, "hate": 1.6}


def plain_features(text):
    """The features that can be told without the module's helpers, by name, for words with edges of , . ! ? only."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    look = str.maketrans("013457@$!|", "oieastasil")

    def bare(w):
        w = w.strip(",.!?;:").lower()
        if w and not w.isalpha() and any(map(str.isalpha, w)):
            w = "".join(c for c in w.translate(look) if c.isalpha())
        return re.sub(r"(.)\1{2,}", r"\1", w)

    weight = [next((LEXICON[t] for t in (bare(w), bare(w)[:5] + "*" if len(bare(w)) > 5 else "") if t in LEXICON), 0.0) for w in words]
    hits = [i for i, x in enumerate(weight) if x]
    you = [i for i, w in enumerate(words) if bare(w) in ("you", "your", "du")]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in hits)
    return {
        "log_words": math.log1p(len(words)), "hit_density": len(hits) / n, "weight_density": sum(weight) / n, "log_hits": math.log1p(len(hits)), "top_weight": max(weight, default=0.0),
        "near_second_person": near / n, "second_person": len(you) / n, "capitals": sum(map(str.isupper, text)) / size, "all_caps_words": sum(len(w) > 1 and w.isupper() for w in words) / n,
        "exclamations": text.count("!") / size, "questions": text.count("?") / size, "punctuation": sum(c in ".,;:!?" for c in text) / size, "symbols": sum(c in "#*$%&@|<>" for c in text) / size,
    }


@pytest.mark.parametrize("text", ["", "   ", "a clean text, with words.", "You are an IDIOT! Stupid, stupidly done.", "i hate it; you, far away from here and there and so on, no hit", "1d10t and h4te for you? ST0PID stuuuupid", "du Idiot " * 300, "#1 @home <b> & |x|"])
def test_features_equal_a_plain_version(text):
    got = dict(zip(toxicity.NAMES, toxicity.features(text, toxicity.Words(LEXICON))))
    want = plain_features(text)
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_plain_words_and_terms():
    assert [toxicity.plain(w) for w in ("Idiot!!", "1d10t", "stuuupid", "(hate)", "12", "@ss", "...", "")] == ["idiot", "idiot", "stupid", "hate", "12", "ass", "", ""]
    assert toxicity.terms("Stupid stupid a") == {"stupid", "stupi*", "a"}


def test_hidden_and_obfuscated_words():
    got = dict(zip(toxicity.NAMES, toxicity.features("1d10t idiot h4te stuuuupid", toxicity.Words(LEXICON))))
    assert (got["hidden_hits"], got["obfuscated_words"], got["stretched_words"], got["distinct_hits"]) == (3 / 4, 2 / 4, 1 / 4, 3)
