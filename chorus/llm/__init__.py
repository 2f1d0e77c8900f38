"""Training-data operators: de-duplication, fingerprints, sharding, language
identification, mixing, token counts, decontamination and WARC archives.

Nothing outside this package imports it; the queries are in
:mod:`chorus.llm.queries`."""

import sys

from pyspark import cloudpickle

# The functions that run in tasks travel with the plan: executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
