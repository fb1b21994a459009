"""Recognition, anonymization, restoration and corpus reports over DataFrames."""
