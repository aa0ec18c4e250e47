"""Training-data operators: filtering, de-duplication, language, packing and archives."""
