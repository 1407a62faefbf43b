"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

#: Fixed values of the data model.
ERR_ADDRESS = "errAddress"
BURN_ADDRESS = "1111111111111111111114oLvT2"
ZERO_SENSIBLE_ID = "0" * 72
ZERO_TXID = "0" * 64
UNCONFIRMED_HEIGHT = -1
DUST, SPENDABLE_FLOOR = 600, 1000
NOT_USED, NOT_MATCHED = "not_used-usedFtIncomeStore_not_found", "not_used-not_match"

RAW_BLOCKS = (
    "height BIGINT, block_hash STRING, block_time TIMESTAMP_NTZ, transactions ARRAY<STRUCT<tx_id: STRING,"
    " inputs: ARRAY<STRUCT<prev_tx_id: STRING, prev_vout: INT>>, outputs: ARRAY<STRUCT<address: STRING, amount_sat: BIGINT>>>>"
)
BLOCKS = (
    "height BIGINT, block_hash STRING, prev_hash STRING, version INT, merkle_root STRING, block_time TIMESTAMP_NTZ,"
    " median_time TIMESTAMP_NTZ, bits STRING, nonce BIGINT, size BIGINT, tx_count INT, miner STRING, reward_sat BIGINT"
)
OUTPUTS = "tx_id STRING, vout INT, address STRING, amount_sat BIGINT, block_time TIMESTAMP_NTZ, height BIGINT"
SPENDS = "prev_tx_id STRING, prev_vout INT, address STRING, spend_tx_id STRING, block_time TIMESTAMP_NTZ, height BIGINT"
MEMPOOL_OUTPUTS = "tx_id STRING, vout INT, address STRING, amount_sat BIGINT, seen_time TIMESTAMP_NTZ"
MEMPOOL_SPENDS = "prev_tx_id STRING, prev_vout INT, address STRING, spend_tx_id STRING, seen_time TIMESTAMP_NTZ"
MEMPOOL_TXS = (
    "tx_id STRING, seen_time TIMESTAMP_NTZ, inputs ARRAY<STRUCT<prev_tx_id: STRING, prev_vout: INT>>,"
    " outputs ARRAY<STRUCT<address: STRING, amount_sat: BIGINT>>"
)
TOKEN_OUTPUTS = (
    "tx_id STRING, vout INT, contract_type STRING, address STRING, code_hash STRING, genesis STRING, sensible_id STRING,"
    " name STRING, symbol STRING, decimals SMALLINT, amount DECIMAL(20,0), value_sat BIGINT, custom_data STRING,"
    " height BIGINT, block_time_ms BIGINT"
)
TOKEN_SPENDS = (
    "prev_tx_id STRING, prev_vout INT, used_tx_id STRING, contract_type STRING, address STRING, code_hash STRING,"
    " genesis STRING, sensible_id STRING, amount DECIMAL(20,0), value_sat BIGINT, height BIGINT, block_time_ms BIGINT"
)
NFT_OUTPUTS = (
    "tx_id STRING, vout INT, address STRING, code_hash STRING, genesis STRING, sensible_id STRING, token_index DECIMAL(20,0),"
    " token_supply DECIMAL(20,0), meta_tx_id STRING, meta_vout BIGINT, value_sat BIGINT, height BIGINT, block_time_ms BIGINT"
)
NFT_SPENDS = (
    "prev_tx_id STRING, prev_vout INT, used_tx_id STRING, address STRING, code_hash STRING, genesis STRING,"
    " token_index DECIMAL(20,0), height BIGINT, block_time_ms BIGINT"
)
NFT_LISTINGS = (
    "tx_id STRING, vout INT, seller STRING, contract_address STRING, code_hash STRING, genesis STRING,"
    " token_index DECIMAL(20,0), price DECIMAL(20,0), value_sat BIGINT, height BIGINT"
)
INDEXER_LOG = (
    "id BIGINT, height INT, block_hash STRING, expected_in INT, expected_out INT, actual_in INT, actual_out INT, tx_num BIGINT,"
    " address_num BIGINT, new_address_num BIGINT, completion_time BIGINT, block_time BIGINT, reorg INT"
)
REORG_LOG = "id BIGINT, height BIGINT, end_height BIGINT, block_hash STRING, new_block_hash STRING, reorg_size BIGINT, timestamp BIGINT, status INT"
ERR_LOG = "id BIGINT, err_type INT, height BIGINT, block_hash STRING, timestamp BIGINT, error_message STRING"
