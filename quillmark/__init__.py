"""quillmark: Spark jobs that evaluate information extracted from document collections."""
