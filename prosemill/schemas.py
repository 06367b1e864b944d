"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
SENTENCE = "doc_id long, sid int, text string, start int, end int, word_count int"
TOKEN = "doc_id long, tok_idx int, start_char int, end_char int, logprob double, entropy double"
CLEAN_CORPUS = "text string, label int"
POLISHED_CORPUS = "text string, original_text string, label int, source string, prompt_variant string"
POLISH_CACHE = "index int, prompt_variant string, text string, original_text string, model string, created_at string"
FAILURE = "timestamp string, index int, prompt_variant string, reason string"
LIMITER_EVENT = "key string, ts double"
RESPONSE_SENTENCE = (
    "struct<index:int,text:string,start_char:int,end_char:int,word_count:int,perplexity:double,mean_logprob:double,"
    "ai_likelihood:double,phrase:string,flagged:boolean,reason:string,local_score:double,ppl_z:double,length_z:double>"
)
