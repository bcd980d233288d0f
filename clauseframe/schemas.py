"""The types of documents, passages, annotations, examples, calls and metadata: one place for all of them."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CONTEXT = T.ArrayType(_struct(text=_S, type=_S))
#: ``performed`` is null in the privacy-practice scheme.
ANNOTATION = _struct(requirement=_S, value=_S, performed=_B)
ANNOTATIONS = T.ArrayType(ANNOTATION)
PASSAGE = _struct(idx=_I, type=_S, context=CONTEXT, passage=_S)
POLICY_ROW = _struct(type=_S, context=CONTEXT, passage=_S, annotations=ANNOTATIONS)
MESSAGE = _struct(role=_S, content=_S)
EXAMPLE = _struct(
    index=_I, type=_S, example_type=_S, context=CONTEXT, passage=_S, annotations=ANNOTATIONS, labels=T.ArrayType(_S), source_file=_S, source_index=_I,
    embedding=T.ArrayType(T.FloatType()),
)
STATIC_EXAMPLE = _struct(passage=_S, requirement=_S, annotation_value=_S, performed=_B, confidence=_D, source_policy=_S, difficulty_level=_S)
LEGAL_RECORD = _struct(
    label=_S, gdpr_references=T.ArrayType(_S), legal_text=_S, commentary=_S, plain_summary=_S,
    examples=T.ArrayType(_struct(policy_snippet=_S, annotation=_struct(span=_S, label=_S), explanation=_S)),
    source_references=T.ArrayType(_struct(type=_S, link=_S)), last_updated=_S, version=_S,
)
CATEGORY_RECORD = _struct(label=_S, description=_S, usage=_S)
LEGAL_INDEX = _struct(requirements_overview=T.ArrayType(_struct(requirement_number=_I, label=_S, gdpr_references=T.ArrayType(_S), file=_S, description=_S)))
CATEGORY_INDEX = _struct(categories_overview=T.ArrayType(_struct(category_number=_I, label=_S, file=_S, description=_S, key_attributes=T.ArrayType(_S))))
INDEX_INFO = _struct(
    model_name=_S, embedding_dimension=_I, total_examples=_struct(annotate=_I, classify=_I), total_embeddings=_struct(annotate=_I, classify=_I), created_at=_S
)
MODEL_PRICE = _struct(
    key=_S, name=_S, api=_S, encoding=_S, input_price=_D, input_price_cached=_D, output_price=_D, input_price_batch=_D, output_price_batch=_D, supports_json=_B
)
LLM_CALL = _struct(
    custom_id=_S, task=_S, pkg=_S, idx=_I, model=_S, response=_S, in_tokens=_L, cached_tokens=_L, out_tokens=_L, cost=_D, secs=_D, error=_S
)
BATCH_RESPONSE_A = _struct(
    custom_id=_S, error=_S,
    response=_struct(
        status_code=_I,
        body=_struct(choices=T.ArrayType(_struct(finish_reason=_S, message=_struct(content=_S))), usage=_struct(prompt_tokens=_L, completion_tokens=_L)),
    ),
)
BATCH_RESPONSE_B = _struct(
    custom_id=_S, result=_struct(type=_S, message=_struct(content=T.ArrayType(_struct(text=_S)), usage=_struct(input_tokens=_L, output_tokens=_L)))
)
BATCH_STATUS = _struct(
    id=_S, status=_S, created_at=T.TimestampType(), ended_at=T.TimestampType(), expires_at=T.TimestampType(), processing=_I, succeeded=_I, errored=_I, canceled=_I,
    expired=_I,
)
APP_METADATA = _struct(
    app_name=_S, developer=_S, rating=_D, review_count=_S, download_count=_S, content_rating=_S, features=T.ArrayType(_S), app_icon_url=_S, package_id=_S,
    price=_S, install_button_text=_S, available_in_country=_B, app_description=_S, short_description=_S, last_updated=_S, available_platforms=T.ArrayType(_S),
    app_ranking=_S, app_categories=T.ArrayType(_S), developer_website=_S, support_email=_S, privacy_policy_url=_S, company_name=_S, company_email=_S,
    company_address=_S, company_phone=_S,
)
ERROR = _struct(pkg=_S, stage=_S, message=_S)
