"""Operators for preparing large text corpora: quality, licences, packing, urls, tokens, chats, toxicity, language, near duplicates, leaks."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
