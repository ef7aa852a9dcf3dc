"""Schemas of records and tables."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _ss = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FILING = _struct(
    id=_s, ciks=_ss, ticker=_ss, period_ending=_s, file_num=_ss, display_names=_ss, xsl=_s, sequence=_s, root_forms=_ss, file_date=_s, biz_states=_ss, sics=_ss, form=_s, adsh=_s,
    film_num=_ss, biz_locations=_ss, file_type=_s, file_description=_s, inc_states=_ss, file_path_name=_s, keyword=_s, file_container_type=_s,
)
RAW_RECORD = _struct(metadata=_struct(filing=FILING, keyword=_s), core_text=_s, url=_s)
WINDOW = _struct(matched_phrase=_s, context=_s, hit_sentence_index=T.IntegerType(), context_start_index=T.IntegerType(), context_end_index=T.IntegerType(), char_cutoff_applied=T.BooleanType(), similarity_score=T.DoubleType())
PROCESSED_RECORD = _struct(metadata=_struct(filing=FILING, keyword=_s), url=_s, context=T.ArrayType(WINDOW), all_context_windows=_s, filings_average=T.DoubleType())
FILINGS = _struct(
    id=_s, ciks=_ss, ticker=_ss, display_names=_ss, root_forms=_ss, film_num=_ss, keywords=_ss, period_ending=T.DateType(), file_date=T.DateType(), form=_s, adsh=_s, file_type=_s, file_description=_s,
    blacklisted=T.BooleanType(), project_relevant=T.BooleanType(), path_to_raw=_s, path_to_preprocessed=_s, path_to_classified=_s, url=_s, last_crawled=T.TimestampType(),
)
PREPROCESSING = _struct(filing_id=_s, preprocessing_version=_s, project_relevant=T.BooleanType(), path_to_preprocessed=_s, processed_at=T.TimestampType())
CLASSIFICATIONS_KEY = _struct(filing_id=_s, experiment_version=_s)
SEARCH_QUERY = _struct(
    query_base=_s, keyword=_s, from_date=_s, to_date=_s, date_range=_s, individual_search_ticker=_ss, individual_search_cik=_s, individual_search_title=_s, filing_category=_s, filing_categories=_ss,
    filing_limit=T.IntegerType(), force_crawl=T.BooleanType(),
)
SEARCH_CONFIG = _struct(queries=T.MapType(_s, SEARCH_QUERY))
SEARCH_PAGE = _struct(
    query=_struct(size=T.IntegerType()),
    hits=_struct(total=_struct(value=T.LongType()), hits=T.ArrayType(_struct(_id=_s, _index=_s, _source=_struct(
        ciks=_ss, period_ending=_s, file_num=_ss, display_names=_ss, xsl=_s, sequence=_s, root_forms=_ss, file_date=_s, biz_states=_ss, sics=_ss, form=_s, adsh=_s, film_num=_ss, biz_locations=_ss, file_type=_s, file_description=_s, inc_states=_ss)))),
)
SCORE = _struct(context_id=_s, similarity_score=T.DoubleType(), model=_s, device=_s, reference_text_id=_s, reference_text=_s, embedding_seconds_total=T.DoubleType(), embedding_ms_per_context=T.DoubleType())
_report = T.MapType(_s, T.MapType(_s, T.MapType(_s, _s)))
EVALUATION = _struct(class_name=_s, model_name=_s, model_input=_s, kwargs=T.MapType(_s, _s), evaluation_results=_report)
#: Names of the groups of forms that a search can ask for, and their codes.
FORM_CATEGORIES = {
    "CUSTOM": "custom",
    "ALL_ANUAL_QUARTERLY_AND_CURRENT_REPORTS": "form-cat1",
    "INSIDER_EQUITY_AWARDS_TRANSACTIONS_AND_OWNERSHIP": "form-cat2",
    "BENEFICIAL_OWNERSHIP_REPORTS": "form-cat3",
    "EXEMPT_OFFERINGS": "form-cat4",
    "REGISTRATION_STATEMENTS_AND_PROSPECTUSES": "form-cat5",
    "FILING_REVIEW_CORRESPONDENCE": "form-cat6",
    "SEC_ORDERS_AND_NOTICES": "form-cat7",
    "PROXY_MATERIALS": "form-cat8",
    "TENDER_OFFERS_AND_GOING_PRIVATE_TRANSACTIONS": "form-cat9",
    "TRUST_INDENTURE_FILINGS": "form-cat10",
    "ALL": "",
}
CATEGORY = _struct(
    class_name=_s, name=_s, properties=T.ArrayType(_struct(name=_s, description=_s, type=_s)), prompt_base=_s, csv_path=_s, num_examples=T.IntegerType(),
    examples=T.ArrayType(_struct(text=_s, answer=T.ArrayType(_struct(column_name=_s, value=_s)))),
)
