import random

import numpy as np

from ledgerproof.llm import langid

WORDS = {
    "aa": "the thing over water stone with light house under green river some".split(),
    "bb": "der auch nicht schön über wasser licht haus unter grün fluss manche".split(),
    "cc": "como pueblo ciudad noche amigo verde siempre nunca camino luz cuando ella".split(),
    "dd": "kyllä metsä järvi talo yö ystävä vihreä aina tie valo kun hänen".split(),
}
OTHER = "zgrz psczyk wjodkw czwór mlyk dzwqn przqd kwjt szczp bzyk drzw grzyb".split()


def text(rng, *langs, n=40):
    return " ".join(rng.choice(WORDS[lang]) for lang in langs for _ in range(n))


def test_unlearned_languages_are_rejected():
    """Words of an unlearned language and gibberish in the script of the learned ones, with two labels and with four."""
    rng = random.Random(5)
    strange = [" ".join(rng.choice(OTHER) for _ in range(40)) for _ in range(50)]
    strange += [" ".join("".join(rng.choice("qxzjvkwpy") for _ in range(6)) for _ in range(40)) for _ in range(50)]
    for names in (["aa", "bb"], ["aa", "bb", "cc"], list(WORDS)):
        labels = [names[i % len(names)] for i in range(300)]
        model = langid.fit([text(rng, x) for x in labels], labels)
        assert np.mean(model.decide(strange)[2]) > 0.95, names
        assert np.mean(model.decide([text(rng, x) for x in labels])[2]) < 0.02, names
        mixed = [text(rng, *rng.sample(names, 2)) for _ in range(100)]
        assert np.mean(model.decide(mixed)[2]) < 0.05, names
