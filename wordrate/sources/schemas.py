"""Explicit schemas of the request / result dialects (JSON is never inferred).

Three dialects exist: ``openai`` (chat completions, id ``custom_id``), ``google``
(contents/parts, id ``key``) and ``local`` (flat prompt, id ``id``).  The *union*
schemas let one scan read files of any dialect; the dialect is then decided per row.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TOKEN = "token:string,logprob:double,bytes:array<int>"
_STEP = f"struct<{_TOKEN},top_logprobs:array<struct<{_TOKEN}>>>"
_CHOICE = (f"struct<index:int,message:struct<role:string,content:string,refusal:string>,"
           f"logprobs:struct<content:array<{_STEP}>>,finish_reason:string>")
_CANDIDATE_TOKEN = "struct<logProbability:double,token:string,tokenId:int>"
_CANDIDATE = ("struct<avgLogprobs:double,content:struct<parts:array<struct<text:string>>,role:string>,"
              "finishReason:string,"
              f"logprobsResult:struct<chosenCandidates:array<{_CANDIDATE_TOKEN}>,"
              f"topCandidates:array<struct<candidates:array<{_CANDIDATE_TOKEN}>>>>>")
_GEN_CONFIG = "struct<temperature:double,response_logprobs:boolean,logprobs:int>"
_GEN_CONFIG_CAMEL = "struct<temperature:double,responseLogprobs:boolean,logprobs:int>"
_CONTENTS = "array<struct<role:string,parts:array<struct<text:string>>>>"
GOOGLE_REQUEST_BODY = (f"struct<model:string,contents:{_CONTENTS},generation_config:{_GEN_CONFIG},"
                       f"generationConfig:{_GEN_CONFIG_CAMEL}>")

OPENAI_REQUEST = (
    "custom_id string, method string, url string, "
    "body struct<model:string,temperature:double,logprobs:boolean,top_logprobs:int,"
    "response_format:struct<type:string>,messages:array<struct<role:string,content:string>>>"
)
GOOGLE_REQUEST = f"key string, request {GOOGLE_REQUEST_BODY}"
LOCAL_REQUEST = ("id string, prompt string, temperature double, response_logprobs boolean, "
                 "logprobs int, model string, ft_dir string")

OPENAI_RESPONSE_BODY = (f"struct<id:string,object:string,created:bigint,model:string,choices:array<{_CHOICE}>,"
                        "usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>>")
OPENAI_RESULT = ("id string, custom_id string, error string, "
                 f"response struct<status_code:int,request_id:string,body:{OPENAI_RESPONSE_BODY}>")
GOOGLE_RESULT = (
    "key string, status string, processed_time string, "
    f"request {GOOGLE_REQUEST_BODY}, "
    f"response struct<candidates:array<{_CANDIDATE}>,createTime:string,modelVersion:string,responseId:string,"
    "usageMetadata:struct<candidatesTokenCount:int,promptTokenCount:int,totalTokenCount:int>>"
)
LOCAL_RESULT = f"id string, response struct<status_code:int,request_id:string,body:{OPENAI_RESPONSE_BODY}>"

# One scan for every dialect: field names shared between dialects merge.
REQUEST_UNION = (
    "custom_id string, method string, url string, "
    "body struct<model:string,temperature:double,logprobs:boolean,top_logprobs:int,"
    "response_format:struct<type:string>,messages:array<struct<role:string,content:string>>>, "
    f"key string, request {GOOGLE_REQUEST_BODY}, "
    "id string, prompt string, temperature double, response_logprobs boolean, logprobs int, "
    "model string, ft_dir string"
)
RESULT_UNION = (
    "id string, custom_id string, error string, key string, status string, processed_time string, "
    f"response struct<status_code:int,request_id:string,body:{OPENAI_RESPONSE_BODY},"
    f"candidates:array<{_CANDIDATE}>,createTime:string,modelVersion:string,responseId:string,"
    "usageMetadata:struct<candidatesTokenCount:int,promptTokenCount:int,totalTokenCount:int>>"
)

CHAT_RECORD = "messages array<struct<role:string,content:string>>"
CONTENTS_RECORD = f"contents {_CONTENTS}"

ALTERNATIVES = T.ArrayType(T.StructType([T.StructField("token", T.StringType()),
                                         T.StructField("logprob", T.DoubleType())]))
