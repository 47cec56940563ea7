"""Query 4: all documents as token ids in files, read back."""

import public_tokenizers

from trackguard.llm import token_files as K
from trackguard.llm.catalog import query, table


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    return K.digests(K.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
