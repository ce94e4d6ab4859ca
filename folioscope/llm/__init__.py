"""Operations of a training-data pipeline over documents, pages and conversations.

One module an operator; ``queries`` registers them.  Nothing outside this
package imports it.  Its functions are sent to the executors by value, so they
need no installation there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
