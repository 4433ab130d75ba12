"""Weftline: web-content analytics as PySpark DataFrame operators.

Operators take DataFrames (or Columns) and return DataFrames (or Columns); nothing here fetches from a network.
The subpackage ``weftline.llm`` holds the training-data operators and is optional: nothing else imports it.
"""

__version__ = "0.1.0"
