"""Grammatical features of texts as a long table of counts, from one pass over neighbouring tokens.

A feature is a condition on a token and its neighbours. Those that need a parser (``TAGGED``) come from an
optional tagger and are else absent, which is not a count of 0. f_43 and f_44 are no rates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import is_word, tokens

#: Word lists of the closed classes.
LEXICON = {
    "f_04_place_adverbials": "aboard above abroad across ahead alongside around ashore astern away behind below beneath beside downhill downstairs downstream east far hereabouts indoors inland inshore inside locally near nearby north nowhere outdoors outside overboard overland overseas south underfoot underground underneath uphill upstairs upstream west",
    "f_05_time_adverbials": "afterwards again earlier early eventually formerly immediately initially instantly late lately later momentarily now nowadays once originally presently previously recently shortly simultaneously soon subsequently today tomorrow tonight yesterday",
    "f_06_first_person_pronouns": "i me my mine myself we us our ours ourselves",
    "f_07_second_person_pronouns": "you your yours yourself yourselves",
    "f_08_third_person_pronouns": "he him his himself she her hers herself they them their theirs themselves",
    "f_09_pronoun_it": "it its itself",
    "f_11_indefinite_pronouns": "anybody anyone anything everybody everyone everything nobody none nothing nowhere somebody someone something",
    "f_35_because": "because",
    "f_36_though": "though although",
    "f_37_if": "if unless",
    "f_38_other_adv_sub": "since while whilst whereupon whereas whereby",
    "f_39_prepositions": "against amid amidst among amongst at besides between by despite during except for from in into minus notwithstanding of off on onto opposite out per plus than through throughout thru to toward towards upon versus via with within without",
    "f_45_conjuncts": "alternatively altogether consequently conversely e.g. else furthermore hence however i.e. instead likewise moreover namely nevertheless nonetheless notwithstanding otherwise rather similarly therefore thus viz",
    "f_46_downtoners": "almost barely hardly merely mildly nearly only partially partly practically scarcely slightly somewhat",
    "f_47_hedges": "maybe perhaps possibly roughly approximately",
    "f_48_amplifiers": "absolutely altogether completely enormously entirely extremely fully greatly highly intensely perfectly strongly thoroughly totally utterly very",
    "f_49_emphatics": "just really most more such",
    "f_52_modal_possibility": "can may might could",
    "f_53_modal_necessity": "ought should must",
    "f_54_modal_predictive": "will would shall",
    "f_55_verb_public": "acknowledge add admit affirm agree allege announce argue assert bet boast certify claim comment complain concede confess confide confirm contend convey declare deny disclose exclaim explain forecast foretell guarantee hint insist maintain mention object predict proclaim promise pronounce prophesy protest remark repeat reply report say said says state submit suggest swear testify vow warn write",
    "f_56_verb_private": "anticipate assume believe believed believes conclude decide deem demonstrate discover doubt estimate fear feel felt find forget guess hear hope imagine imply indicate infer know knew known learn mean notice observe perceive presume presuppose prove realize reason recall reckon recognize reflect remember reveal see seen sense show shown suppose suspect think thought understand",
    "f_57_verb_suasive": "agree allow arrange ask beg command concede decide decree demand desire determine enjoin ensure entreat grant insist instruct intend move ordain order pledge pray prefer pronounce propose recommend request require resolve rule stipulate suggest urge vote",
    "f_58_verb_seem": "seem seems seemed seeming appear appears appeared appearing",
}
BE = "am is are was were be been being 's 're 'm".split()
HAVE = "have has had having 've".split()
AUX = BE + HAVE + "do does did can may might could will would shall should must ought".split()
WH = "who what where when why which whose whom how".split()
DETERMINERS = "a an the this that these those my your his her its our their".split()
SUBJECTS = "i you he she it we they".split()
DEMONSTRATIVES = "this that these those".split()
PARTICLES = "well now anyway anyhow anyways".split()
PUBLIC_PRIVATE = [w for f in ("f_55_verb_public", "f_56_verb_private", "f_57_verb_suasive") for w in LEXICON[f].split()]
PREPOSITIONS = LEXICON["f_39_prepositions"].split()
COMPLEMENT_ADJECTIVES = "afraid amazed aware certain clear confident glad happy likely obvious possible probable sorry sure surprised true unlikely".split()
END = [".", "!", "?"]

#: Features that need a tagger or parser.
TAGGED = (
    "f_01_past_tense f_03_present_tense f_12_proverb_do f_15_gerunds f_16_other_nouns f_27_past_participle_whiz f_28_present_participle_whiz f_29_that_subj "
    "f_30_that_obj f_31_wh_subj f_32_wh_obj f_40_adj_attr f_41_adj_pred f_60_that_deletion f_64_phrasal_coordination"
).split()
NO_RATE = ("f_43_type_token", "f_44_mean_word_length")
TYPE_TOKEN_WINDOW = 400
#: Names of features that count more.
KEY_TELLS = "participle nominalization phrasal_coordination that_verb_comp that_adj_comp agentless_passive downtoner".split()


def conditions() -> dict[str, Column]:
    """The condition of each feature on the columns p1, t, n1, n2, n3: a token and its neighbours."""
    t, p1, n1, n2, n3 = (F.col(c) for c in ("t", "p1", "n1", "n2", "n3"))
    start = p1.isNull() | p1.isin(*END)
    # a look at the ending first: most tokens never get to a pattern
    ends = lambda c, *e: reduce(lambda a, b: a | b, [c.endswith(x) for x in e])
    participle = lambda c: ends(c, "ed", "en") & c.rlike("^[a-z]{2,}(?:ed|en)$")
    adverb = lambda c: ends(c, "ly") & c.rlike("^[a-z]{2,}ly$")
    verb_like = lambda c: ends(c, "ed", "s") & c.rlike("^[a-z]{2,}(?:ed|s)$")
    quoted = t.contains("'") | t.contains("’")
    out = {name: t.isin(*words.split()) for name, words in LEXICON.items()}
    passive = t.isin(*BE) & (participle(n1) | (adverb(n1) & participle(n2)))
    by = F.when(participle(n1), n2 == "by").otherwise(n3 == "by")
    demonstrative = n1.isin(*AUX) | n1.isin(*END, ",", ";", ":") | verb_like(n1)
    out |= {
        "f_02_perfect_aspect": t.isin(*HAVE) & (participle(n1) | participle(n2) | participle(n3)),
        "f_10_demonstrative_pronoun": t.isin(*DEMONSTRATIVES) & demonstrative,
        "f_13_wh_question": start & t.isin(*WH) & n1.isin(*AUX),
        "f_14_nominalizations": ends(t, "tion", "ment", "ness", "ity", "tions", "ments", "nesses", "ities") & t.rlike("^[a-z]{2,}(?:tion|ment|ness|ity|tions|ments|nesses|ities)$") & (F.length(t) > 5),
        "f_17_agentless_passives": passive & ~F.coalesce(by, F.lit(False)),
        "f_18_by_passives": passive & by,
        "f_19_be_main_verb": t.isin(*BE) & (n1.isin(*DETERMINERS) | n1.isin(*PREPOSITIONS)),
        "f_20_existential_there": (t == "there") & n1.isin(*BE),
        "f_21_that_verb_comp": t.isin(*PUBLIC_PRIVATE) & (n1 == "that"),
        "f_22_that_adj_comp": t.isin(*COMPLEMENT_ADJECTIVES) & (n1 == "that"),
        "f_23_wh_clause": t.isin(*PUBLIC_PRIVATE) & n1.isin(*WH),
        "f_24_infinitives": (t == "to") & n1.rlike("^[a-z]+$") & ~n1.isin(*DETERMINERS, *SUBJECTS, *PREPOSITIONS),
        "f_25_present_participle": (start | (p1 == ",")) & t.rlike("^[a-z]{3,}ing$"),
        "f_26_past_participle": (start | (p1 == ",")) & participle(t),
        "f_33_pied_piping": t.isin(*PREPOSITIONS) & n1.isin("which", "whom", "whose", "who"),
        "f_34_sentence_relatives": (t == ",") & (n1 == "which"),
        "f_42_adverbs": adverb(t),
        "f_50_discourse_particles": start & t.isin(*PARTICLES),
        "f_51_demonstratives": t.isin(*DEMONSTRATIVES) & ~F.coalesce(demonstrative, F.lit(False)),
        "f_59_contractions": quoted & t.rlike("^[a-z]+['’](?:s|t|re|ve|ll|d|m)$"),
        "f_61_stranded_preposition": t.isin(*PREPOSITIONS) & n1.isin(*END, ",", ";", ":"),
        "f_62_split_infinitive": (t == "to") & adverb(n1) & n2.rlike("^[a-z]+$"),
        "f_63_split_auxiliary": t.isin(*AUX) & adverb(n1) & n2.rlike("^[a-z]{3,}$"),
        "f_65_clausal_coordination": t.isin("and", "but", "or") & (start | ((p1 == ",") & n1.isin(*SUBJECTS, *DEMONSTRATIVES))),
        "f_66_neg_synthetic": t.isin("neither", "nor") | ((t == "no") & is_word(n1)),
        "f_67_neg_analytic": (t == "not") | quoted & t.rlike("^[a-z]+n['’]t$"),
    }
    return dict(sorted(out.items()))


def neighbours(docs: DataFrame, key: list[str]) -> DataFrame:
    """The key's columns and each token with its neighbours p1, n1, n2, n3; a row's tokens never leave its task.

    The neighbours are the token array moved by so many places; zipped before they are taken apart, so that
    no row carries an array.
    """
    t = docs.select(*key, tokens(F.col("text")).alias("_t"))
    after = lambda k: F.slice("_t", k + 1, F.size("_t"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("_t"))
    zipped = F.arrays_zip(F.col("_t").alias("t"), before.alias("p1"), after(1).alias("n1"), after(2).alias("n2"), after(3).alias("n3"))
    return t.select(*key, F.explode(zipped).alias("_z")).select(*key, "_z.*").where("t is not null")


def lexicon(spark: SparkSession) -> DataFrame:
    """(t, mask): each word of the closed classes, with a bit for each class that has it."""
    masks: dict[str, int] = {}
    for i, words in enumerate(LEXICON.values()):
        for w in words.split():
            masks[w] = masks.get(w, 0) | 1 << i
    return spark.createDataFrame(sorted(masks.items()), "t string, mask long")


def wide_counts(docs: DataFrame, key: list[str]) -> DataFrame:
    """A row for each text: tokens (words, not marks) and a count for each feature, in one pass over its tokens.

    Words of closed classes are looked up in a broadcast table, which has as many rows as they have words.
    """
    rows = neighbours(docs, key).join(F.broadcast(lexicon(docs.sparkSession)), "t", "left")
    sums = {n: F.count_if(c) for n, c in conditions().items() if n not in LEXICON}
    sums |= {n: F.coalesce(F.sum(F.shiftright("mask", i).bitwiseAND(1)), F.lit(0)) for i, n in enumerate(LEXICON)}
    return rows.groupBy(key).agg(F.count_if(is_word(F.col("t"))).alias("tokens"), *[sums[n].alias(n) for n in sorted(sums)])


def long_counts(wide: DataFrame, key: list[str]) -> DataFrame:
    """(key, feature, n, tokens, rate): the counts of ``wide_counts`` as rows, with rates per 1,000 words."""
    long = wide.where("tokens > 0").unpivot([*key, "tokens"], sorted(conditions()), "feature", "n")
    return long.select(*key, "feature", "n", "tokens", (F.lit(1000.0) * F.col("n") / F.col("tokens")).alias("rate"))


def counts(docs: DataFrame, key: list[str] = ("doc_id",), tagger: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, feature, n, tokens, rate): long counts and rates per 1,000 words.

    ``tagger`` gives (key, feature, n) of features in TAGGED, as ``tagging.tagged`` does; without it these have no rows.
    """
    key = list(key)
    wide = wide_counts(docs, key)
    long = long_counts(wide, key)
    if tagger:
        more = tagger(docs).join(wide.where("tokens > 0").select(*key, "tokens"), key)
        long = long.unionByName(more.select(*key, "feature", F.col("n").cast("long").alias("n"), "tokens", (F.lit(1000.0) * F.col("n") / F.col("tokens")).alias("rate")))
    return long


def word_shape(docs: DataFrame, key: list[str] = ("doc_id",), window: int = TYPE_TOKEN_WINDOW) -> DataFrame:
    """(key, f_43_type_token, f_44_mean_word_length): over the first ``window`` words, and over all."""
    words = F.filter(tokens(F.col("text")), is_word)
    out = docs.select(*key, words.alias("_w")).where(F.size("_w") > 0)
    head = F.slice("_w", 1, window)
    mean = F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).cast("double") / F.size("_w")
    return out.select(*key, (F.size(F.array_distinct(head)).cast("double") / F.size(head)).alias("f_43_type_token"), mean.alias("f_44_mean_word_length"))


def pivoted(features: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """The long table as a row for each text, with a column for each feature; absent ones are null."""
    names = sorted([*conditions(), *TAGGED])
    return features.groupBy(*key).pivot("feature", names).agg(F.first("rate"))


def is_key_tell(feature: Column) -> Column:
    return feature.rlike("|".join(KEY_TELLS))
