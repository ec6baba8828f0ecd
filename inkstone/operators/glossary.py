"""What each feature is, and what to look at where its rate leaves the band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Our own wording: (feature, what it counts).
MEANING = {
    "f_01_past_tense": "verbs in the past tense", "f_02_perfect_aspect": "verbs in the perfect", "f_03_present_tense": "verbs in the present tense",
    "f_04_place_adverbials": "adverbs of place", "f_05_time_adverbials": "adverbs of time", "f_06_first_person_pronouns": "pronouns of the first person",
    "f_07_second_person_pronouns": "pronouns of the second person", "f_08_third_person_pronouns": "pronouns of the third person", "f_09_pronoun_it": "the pronoun it",
    "f_10_demonstrative_pronoun": "this, that, these and those on their own", "f_11_indefinite_pronouns": "pronouns such as anyone and nothing",
    "f_12_proverb_do": "do in place of another verb", "f_13_wh_question": "questions with a wh-word", "f_14_nominalizations": "nouns made of verbs and adjectives",
    "f_15_gerunds": "-ing forms used as nouns", "f_16_other_nouns": "plain nouns", "f_17_agentless_passives": "passives that name no agent",
    "f_18_by_passives": "passives with by", "f_19_be_main_verb": "be as the main verb", "f_20_existential_there": "there is and there are",
    "f_21_that_verb_comp": "that-clauses after a verb", "f_22_that_adj_comp": "that-clauses after an adjective", "f_23_wh_clause": "wh-clauses after a verb",
    "f_24_infinitives": "infinitives with to", "f_25_present_participle": "clauses that open with an -ing form", "f_26_past_participle": "clauses that open with a past participle",
    "f_27_past_participle_whiz": "past participles right after a noun", "f_28_present_participle_whiz": "-ing forms right after a noun",
    "f_29_that_subj": "relative clauses with that as subject", "f_30_that_obj": "relative clauses with that as object", "f_31_wh_subj": "relative clauses with who or which as subject",
    "f_32_wh_obj": "relative clauses with who or which as object", "f_33_pied_piping": "prepositions before which and whom", "f_34_sentence_relatives": "which-clauses on a whole sentence",
    "f_35_because": "because", "f_36_though": "though and although", "f_37_if": "if and unless", "f_38_other_adv_sub": "other conjunctions such as since and while",
    "f_39_prepositions": "prepositions", "f_40_adj_attr": "adjectives before a noun", "f_41_adj_pred": "adjectives after be", "f_42_adverbs": "adverbs in -ly",
    "f_43_type_token": "different words among the first ones", "f_44_mean_word_length": "letters a word", "f_45_conjuncts": "connectors such as however and thus",
    "f_46_downtoners": "words that weaken, such as barely", "f_47_hedges": "hedges such as perhaps", "f_48_amplifiers": "words that strengthen, such as very",
    "f_49_emphatics": "emphatic words such as really", "f_50_discourse_particles": "openings such as well and anyway", "f_51_demonstratives": "this, that, these and those before a noun",
    "f_52_modal_possibility": "can, may, might and could", "f_53_modal_necessity": "ought, should and must", "f_54_modal_predictive": "will, would and shall",
    "f_55_verb_public": "verbs of saying", "f_56_verb_private": "verbs of thinking", "f_57_verb_suasive": "verbs of demanding", "f_58_verb_seem": "seem and appear",
    "f_59_contractions": "contractions", "f_60_that_deletion": "that left out after a verb", "f_61_stranded_preposition": "prepositions at the end of a clause",
    "f_62_split_infinitive": "split infinitives", "f_63_split_auxiliary": "adverbs between auxiliary and verb", "f_64_phrasal_coordination": "pairs of like words joined by and",
    "f_65_clausal_coordination": "clauses joined by and, but and or", "f_66_neg_synthetic": "negation by no, neither and nor", "f_67_neg_analytic": "negation by not",
}
#: Our own advice where a rate is above or below the band; the others have the general one.
ABOVE = {
    "f_14_nominalizations": "Say who does what, with a verb.", "f_17_agentless_passives": "Name who acts where it is known.", "f_18_by_passives": "Turn some passives round.",
    "f_21_that_verb_comp": "Put the claim itself in the main clause.", "f_22_that_adj_comp": "Drop the frame and state the point.", "f_25_present_participle": "Break trailing -ing clauses into sentences.",
    "f_26_past_participle": "Start with the subject more often.", "f_27_past_participle_whiz": "Use a full relative clause or a sentence of its own.",
    "f_28_present_participle_whiz": "Use a full relative clause or a sentence of its own.", "f_46_downtoners": "Keep a weakener only where it changes the claim.",
    "f_64_phrasal_coordination": "Choose one word of a pair where the other adds nothing.", "f_45_conjuncts": "Let the order of sentences carry the link.", "f_40_adj_attr": "Cut adjectives that tell nothing apart.",
}
BELOW = {
    "f_06_first_person_pronouns": "Say who speaks where a text of this kind does.", "f_43_type_token": "Vary the words.", "f_47_hedges": "Mark what is uncertain.",
    "f_59_contractions": "Contract where one would in speech.", "f_67_neg_analytic": "Say plainly what is not the case.", "f_16_other_nouns": "Name concrete things.",
    "f_39_prepositions": "Say where, when and of what.",
}
GENERAL = {1: "Look whether each of them is needed.", -1: "Look whether some are missing."}


def glossary(spark: SparkSession) -> DataFrame:
    """(feature, side, meaning, hint): a row for each feature above (1) and below (-1) its band."""
    rows = [(f, side, m, own.get(f, GENERAL[side])) for f, m in MEANING.items() for side, own in ((1, ABOVE), (-1, BELOW))]
    return spark.createDataFrame(rows, "feature string, side int, meaning string, hint string")
