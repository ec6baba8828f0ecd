"""Parts of speech, and the features that need them.

``tagged`` runs any tagger, a function from a sentence's tokens to their tags, loaded once for a worker process.
``rule_tagger`` is a small one of closed classes, endings and neighbours: good enough for rates over whole texts, not
for single words.

Tags: D determiner, P pronoun, I preposition, C coordinator, S subordinator, M modal, B be, H have, O do, T to,
W wh-word, R adverb, J adjective, N noun, V base verb, Z verb in -s, A past tense, E past participle, G -ing form,
X number, "." mark, ? other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, partial

import pandas as pd
from pyspark.sql import DataFrame

from inkstone.operators import features as X

Tagger = Callable[[list[str]], list[str]]
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*|[^\w\s]|_")
END = (".", "!", "?")

WORDS = {
    "D": "a an the this that these those my your his her its our their some any no every each either neither another all both such",
    "P": "i you he she it we they me him us them who whom myself yourself himself herself itself ourselves themselves mine yours hers ours theirs nobody nothing everybody everyone everything somebody someone something anybody anyone anything none",
    "C": "and or but nor",
    "S": "because although though if unless while whilst whereas since until when whenever where once than whether",
    "M": "can could may might must shall should will would ought",
    "B": "am is are was were be been being 's 're 'm",
    "H": "have has had having 've",
    "O": "do does did doing done",
    "T": "to",
    "W": "which who whom whose what why how",
    "R": "not very too so just only then there here now again also always never often ever still even already yet soon perhaps maybe well almost quite rather however therefore",
    "J": "good new old great small large big long little own other right left same different important public able young few late early high low certain clear free full special hard real best better sure whole true strong short",
    "A": "said went came took made got saw knew thought found gave told felt became left kept began brought wrote sat stood lost paid met ran sent fell held led spoke grew won read",
    "V": "say go come take make get see know think find give tell feel become leave keep begin bring write sit stand lose pay meet run send fall hold lead speak grow win ask need want use try call turn help show play move live believe work seem",
}
PREPOSITIONS = [w for w in X.PREPOSITIONS if w != "to"]
PARTICIPLES = "been made taken given seen known shown written done gone held kept left lost paid sent built found thought brought".split()


@cache
def known() -> dict[str, str]:
    out = {w: "I" for w in PREPOSITIONS}
    for tag, words in reversed(WORDS.items()):
        out |= dict.fromkeys(words.split(), tag)
    return out | {"no": "D", "that": "D"}


def by_form(word: str) -> str:
    """The tag of a word out of context."""
    if not word[0].isalnum():
        return "."
    if word[0].isdigit():
        return "X"
    if tag := known().get(word):
        return tag
    for ending, tag in (("ly", "R"), ("ing", "G"), ("ed", "A")):
        if word.endswith(ending) and len(word) > len(ending) + 2:
            return tag
    if re.search(r"(?:ous|ful|ive|able|ible|al|ic|less|ish|ary)$", word) and len(word) > 4:
        return "J"
    if word.endswith(("ize", "ise", "ify")) and len(word) > 5:
        return "V"
    return "N"


def rule_tagger() -> Tagger:
    """A tagger that corrects the tags of words out of context by their neighbours, from left to right."""
    forms: dict[str, str] = {}

    def tag(words: list[str]) -> list[str]:
        out = []
        for w in words:
            if w not in forms:
                if len(forms) > 200_000:
                    forms.clear()
                forms[w] = by_form(w)
            out.append(forms[w])
        for i, w in enumerate(words):
            before = next((out[k] for k in range(i - 1, max(-1, i - 3), -1) if out[k] != "R"), "")
            after = out[i + 1] if i + 1 < len(out) else "."
            if out[i] in ("N", "J", "Z") and before in ("T", "M", "O"):
                out[i] = "V"
            elif out[i] == "V" and before in ("D", "J", "I"):
                out[i] = "N"
            elif w in PARTICIPLES and before in ("H", "B"):
                out[i] = "E"
            elif out[i] == "A" and (before in ("H", "B") or (before in ("N", "P") and after == "I" and i > 1)):
                out[i] = "E"
            elif out[i] == "A" and before == "D":
                out[i] = "J"
            elif out[i] == "N" and w.endswith("s") and not w.endswith("ss") and (before == "P" or (before == "N" and after in ("D", "P"))):
                out[i] = "Z"
            elif out[i] == "N" and before == "P" and after in ("D", "P", "I", "T", "R"):
                out[i] = "V"
            elif w == "that" and before in ("N",) and after in ("M", "B", "H", "O", "Z", "A", "V", "D", "P", "N"):
                out[i] = "W"
            elif w == "that" and after in ("D", "P"):
                out[i] = "S"
        return out

    return tag


VERBS, NOMINALS = ("M", "B", "H", "O", "Z", "A", "V"), ("D", "P", "N", "J")
NOMINALISATION = re.compile(r"(?:tion|ment|ness|ity)s?$|(?:nesses|ities)$")
TELLING = set(X.PUBLIC_PRIVATE)


def tagged_counts(words: list[str], tags: list[str]) -> Counter:
    """Counts of the features in ``features.TAGGED`` over one sentence."""
    n = Counter()
    at = lambda k: tags[k] if 0 <= k < len(tags) else "."
    for i, (w, t) in enumerate(zip(words, tags, strict=True)):
        before, after = at(i - 1), at(i + 1)
        verb = next((k for k in range(i + 1, min(i + 3, len(tags))) if tags[k] != "R"), None)
        n["f_01_past_tense"] += t == "A" or w in ("was", "were", "had", "did")
        n["f_03_present_tense"] += t == "Z" or w in ("am", "is", "are", "has", "have", "do", "does") or (t == "V" and before in ("P", "N"))
        n["f_12_proverb_do"] += t == "O" and w in ("do", "does", "did") and (verb is None or tags[verb] not in ("V", "P"))
        gerund = t == "G" and (before in ("D", "J", "I") or (after == "I" and at(i - 1) in (".", "D")))
        n["f_15_gerunds"] += gerund
        n["f_16_other_nouns"] += t == "N" and not NOMINALISATION.search(w)
        n["f_27_past_participle_whiz"] += t == "E" and before == "N" and after in ("I", "R")
        n["f_28_present_participle_whiz"] += t == "G" and before == "N"
        if before == "N" and w in ("that", "who", "which", "whom"):
            kind = "that" if w == "that" else "wh"
            n[f"f_29_{kind}_subj" if kind == "that" else "f_31_wh_subj"] += after in VERBS and w != "whom"
            n["f_30_that_obj" if kind == "that" else "f_32_wh_obj"] += after in NOMINALS
        n["f_40_adj_attr"] += t == "J" and after in ("J", "N")
        subject = next((tags[k] for k in range(i - 1, max(-1, i - 3), -1) if tags[k] != "R"), "")
        n["f_41_adj_pred"] += t == "J" and subject == "B" and after not in ("J", "N")
        n["f_60_that_deletion"] += w in TELLING and (after == "P" or (i + 1 < len(words) and words[i + 1] in X.DEMONSTRATIVES)) and at(i + 2) in VERBS
        n["f_64_phrasal_coordination"] += t == "C" and before == after and after in ("N", "J", "R", "V")
    return n


def sentences_of(text: str) -> Iterator[list[str]]:
    held = []
    for w in TOKEN.findall(text.lower()):
        held.append(w)
        if w in END:
            yield held
            held = []
    if held:
        yield held


def _run(batches: Iterator[pd.DataFrame], key: list[str], load: Callable[[], Tagger]) -> Iterator[pd.DataFrame]:
    tagger = loaded(load)
    for batch in batches:
        rows = []
        for *own, text in batch[[*key, "text"]].itertuples(index=False):
            n = Counter(dict.fromkeys(X.TAGGED, 0))
            for words in sentences_of(text or ""):
                n.update(tagged_counts(words, tagger(words)))
            rows += [(*own, f, int(n[f])) for f in X.TAGGED]
        yield pd.DataFrame(rows, columns=[*key, "feature", "n"])


@cache
def loaded(load: Callable[[], Tagger]) -> Tagger:
    """A process loads a tagger once, however many tasks and batches it runs."""
    return load()


def tagged(docs: DataFrame, key: list[str] = ("doc_id",), load: Callable[[], Tagger] = rule_tagger) -> DataFrame:
    """(key, feature, n) of the features in ``features.TAGGED`` for each text; a null or empty text has counts of 0.

    ``load`` makes the tagger; it must be a function of a module, as it goes to the workers by name.
    """
    key = list(key)
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in key)
    return docs.select(*key, "text").mapInPandas(partial(_run, key=key, load=load), f"{kinds}, feature string, n long")
