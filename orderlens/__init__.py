"""orderlens: order-satisfaction analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (chainable with
``DataFrame.transform``); keys and column names are parameters.
"""

__version__ = "0.1.0"
