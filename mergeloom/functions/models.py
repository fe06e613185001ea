"""Which layer of a public model is best for token similarity, and which model a language takes."""

from __future__ import annotations

# Model -> layer.
BEST_LAYER = {
    "bert-base-uncased": 9,
    "bert-large-uncased": 18,
    "bert-base-cased-finetuned-mrpc": 9,
    "bert-base-multilingual-cased": 9,
    "bert-base-chinese": 8,
    "roberta-base": 10,
    "roberta-large": 17,
    "roberta-large-mnli": 19,
    "roberta-base-openai-detector": 7,
    "roberta-large-openai-detector": 15,
    "xlnet-base-cased": 5,
    "xlnet-large-cased": 7,
    "xlm-mlm-en-2048": 6,
    "xlm-mlm-100-1280": 10,
    "allenai/scibert_scivocab_uncased": 8,
    "allenai/scibert_scivocab_cased": 9,
    "nfliu/scibert_basevocab_uncased": 9,
    "distilroberta-base": 5,
    "distilbert-base-uncased": 5,
    "distilbert-base-uncased-distilled-squad": 4,
    "distilbert-base-multilingual-cased": 5,
    "albert-base-v1": 10,
    "albert-large-v1": 17,
    "albert-xlarge-v1": 16,
    "albert-xxlarge-v1": 8,
    "albert-base-v2": 9,
    "albert-large-v2": 14,
    "albert-xlarge-v2": 13,
    "albert-xxlarge-v2": 8,
    "xlm-roberta-base": 9,
    "xlm-roberta-large": 17,
    "google/electra-small-generator": 9,
    "google/electra-small-discriminator": 11,
    "google/electra-base-generator": 10,
    "google/electra-base-discriminator": 9,
    "google/electra-large-generator": 18,
    "google/electra-large-discriminator": 14,
    "google/bert_uncased_L-2_H-128_A-2": 1,
    "google/bert_uncased_L-2_H-256_A-4": 1,
    "google/bert_uncased_L-2_H-512_A-8": 1,
    "google/bert_uncased_L-2_H-768_A-12": 2,
    "google/bert_uncased_L-4_H-128_A-2": 3,
    "google/bert_uncased_L-4_H-256_A-4": 3,
    "google/bert_uncased_L-4_H-512_A-8": 3,
    "google/bert_uncased_L-4_H-768_A-12": 3,
    "google/bert_uncased_L-6_H-128_A-2": 5,
    "google/bert_uncased_L-6_H-256_A-4": 5,
    "google/bert_uncased_L-6_H-512_A-8": 5,
    "google/bert_uncased_L-6_H-768_A-12": 5,
    "google/bert_uncased_L-8_H-128_A-2": 7,
    "google/bert_uncased_L-8_H-256_A-4": 7,
    "google/bert_uncased_L-8_H-512_A-8": 6,
    "google/bert_uncased_L-8_H-768_A-12": 7,
    "google/bert_uncased_L-10_H-128_A-2": 8,
    "google/bert_uncased_L-10_H-256_A-4": 8,
    "google/bert_uncased_L-10_H-512_A-8": 9,
    "google/bert_uncased_L-10_H-768_A-12": 8,
    "google/bert_uncased_L-12_H-128_A-2": 10,
    "google/bert_uncased_L-12_H-256_A-4": 11,
    "google/bert_uncased_L-12_H-512_A-8": 10,
    "google/bert_uncased_L-12_H-768_A-12": 9,
    "amazon/bort": 0,
    "facebook/bart-base": 6,
    "facebook/bart-large": 10,
    "facebook/bart-large-cnn": 10,
    "facebook/bart-large-mnli": 11,
    "facebook/bart-large-xsum": 9,
    "t5-small": 6,
    "t5-base": 11,
    "t5-large": 23,
    "vinai/bertweet-base": 9,
    "microsoft/deberta-base": 9,
    "microsoft/deberta-base-mnli": 9,
    "microsoft/deberta-large": 16,
    "microsoft/deberta-large-mnli": 18,
    "microsoft/deberta-xlarge": 18,
    "microsoft/deberta-xlarge-mnli": 40,
    "YituTech/conv-bert-base": 10,
    "YituTech/conv-bert-small": 10,
    "YituTech/conv-bert-medium-small": 9,
    "microsoft/mpnet-base": 8,
    "squeezebert/squeezebert-uncased": 9,
    "squeezebert/squeezebert-mnli": 9,
    "squeezebert/squeezebert-mnli-headless": 9,
    "tuner007/pegasus_paraphrase": 15,
    "google/pegasus-large": 8,
    "google/pegasus-xsum": 11,
    "sshleifer/tiny-mbart": 2,
    "facebook/mbart-large-cc25": 12,
    "facebook/mbart-large-50": 12,
    "facebook/mbart-large-en-ro": 12,
    "facebook/mbart-large-50-many-to-many-mmt": 12,
    "facebook/mbart-large-50-one-to-many-mmt": 12,
    "allenai/led-base-16384": 6,
    "facebook/blenderbot_small-90M": 7,
    "facebook/blenderbot-400M-distill": 2,
    "microsoft/prophetnet-large-uncased": 4,
    "microsoft/prophetnet-large-uncased-cnndm": 7,
    "SpanBERT/spanbert-base-cased": 8,
    "SpanBERT/spanbert-large-cased": 17,
    "microsoft/xprophetnet-large-wiki100-cased": 7,
    "ProsusAI/finbert": 10,
    "Vamsi/T5_Paraphrase_Paws": 12,
    "ramsrigouthamg/t5_paraphraser": 11,
    "microsoft/deberta-v2-xlarge": 10,
    "microsoft/deberta-v2-xlarge-mnli": 17,
    "microsoft/deberta-v2-xxlarge": 21,
    "microsoft/deberta-v2-xxlarge-mnli": 22,
    "allenai/longformer-base-4096": 7,
    "allenai/longformer-large-4096": 14,
    "allenai/longformer-large-4096-finetuned-triviaqa": 14,
    "zhiheng-huang/bert-base-uncased-embedding-relative-key": 4,
    "zhiheng-huang/bert-base-uncased-embedding-relative-key-query": 7,
    "zhiheng-huang/bert-large-uncased-whole-word-masking-embedding-relative-key-query": 19,
    "google/mt5-small": 8,
    "google/mt5-base": 11,
    "google/mt5-large": 19,
    "google/mt5-xl": 24,
    "google/bigbird-roberta-base": 10,
    "google/bigbird-roberta-large": 14,
    "google/bigbird-base-trivia-itc": 8,
    "princeton-nlp/unsup-simcse-bert-base-uncased": 10,
    "princeton-nlp/unsup-simcse-bert-large-uncased": 18,
    "princeton-nlp/unsup-simcse-roberta-base": 8,
    "princeton-nlp/unsup-simcse-roberta-large": 13,
    "princeton-nlp/sup-simcse-bert-base-uncased": 10,
    "princeton-nlp/sup-simcse-bert-large-uncased": 18,
    "princeton-nlp/sup-simcse-roberta-base": 10,
    "princeton-nlp/sup-simcse-roberta-large": 16,
    "dbmdz/bert-base-turkish-cased": 10,
    "dbmdz/distilbert-base-turkish-cased": 4,
    "google/byt5-small": 1,
    "google/byt5-base": 17,
    "google/byt5-large": 30,
    "microsoft/deberta-v3-xsmall": 10,
    "microsoft/deberta-v3-small": 4,
    "microsoft/deberta-v3-base": 9,
    "microsoft/mdeberta-v3-base": 10,
    "microsoft/deberta-v3-large": 12,
    "khalidalt/DeBERTa-v3-large-mnli": 18,
}

# Language -> model; other languages take the last one.
LANGUAGE_MODEL = {
    "en": "roberta-large",
    "zh": "bert-base-chinese",
    "tr": "dbmdz/bert-base-turkish-cased",
    "en-sci": "allenai/scibert_scivocab_uncased",
}
OTHER_MODEL = "bert-base-multilingual-cased"


def model_of(language: str) -> str:
    return LANGUAGE_MODEL.get(language.lower(), OTHER_MODEL)


def layer_of(model: str, layer: int | None = None) -> int:
    """The given layer, else the model's best one; an unknown model needs a layer."""
    if layer is not None:
        return layer
    if model not in BEST_LAYER:
        raise ValueError(f"give a layer for {model}")
    return BEST_LAYER[model]
