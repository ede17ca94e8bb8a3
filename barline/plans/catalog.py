"""All registered queries and their checking SQL."""

from . import model_queries, news_queries, price_queries, serving_queries

QUERIES, ORACLES = {}, {}
for _module in (price_queries, news_queries, serving_queries, model_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
