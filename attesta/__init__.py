"""attesta: document-fidelity and text-quality analytics on PySpark DataFrames."""
