"""Training-data operators: each module holds one operator, its query and its SQL counterpart."""

from pyspark import cloudpickle

import gleanery

cloudpickle.register_pickle_by_value(gleanery)  # executors get the functions with the job
