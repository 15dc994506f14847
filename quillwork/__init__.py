"""quillwork: DataFrame operators for factorial text experiments and the evidence around them."""
