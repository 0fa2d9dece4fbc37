"""manuscope: document-graph retrieval, text preparation and evidence-gated answering on PySpark.

Every operator takes and returns DataFrames.  ``manuscope.llm`` holds the operators for
training data; nothing outside that folder imports it.
"""
