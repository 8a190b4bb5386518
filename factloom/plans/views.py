"""Derived tables shared by several queries.

The operators work on signals, steps, files and graphs.  These views read the shared
tables as such records: an order is a workflow, its line items are the steps, a nation is
a component, a region a family, a part a source file.  Both engines run the same view text,
so every check compares the operator alone.
"""

from __future__ import annotations

from factloom.plans.registry import template, view

STEP_ORDER = ["pos", "k1", "k2"]

view(
    "steps",
    f"""
    SELECT l_orderkey AS signal_id, l_linenumber AS pos, l_partkey AS k1, l_suppkey AS k2,
      'S' || CAST(l_linenumber AS STRING) ||
        CASE WHEN l_partkey % 23 = 0 THEN '_errorPath' WHEN l_partkey % 19 = 0 THEN '_auditLog' ELSE '' END AS name,
      CASE l_partkey % 9 WHEN 0 THEN 'jdbc' WHEN 1 THEN 'jms' WHEN 2 THEN 'timer' WHEN 3 THEN 'mapper'
        WHEN 4 THEN 'process' WHEN 5 THEN 'http' WHEN 6 THEN 'log' WHEN 7 THEN 'sql:query' ELSE 'shared_sharepoint' END AS connector,
      CASE WHEN l_partkey % 9 IN (0, 7) THEN 'Db' || CAST(l_suppkey % 10 AS STRING) END AS datasource,
      CASE WHEN l_partkey % 9 IN (0, 7) THEN CASE l_suppkey % 4
        WHEN 0 THEN 'SELECT a, b FROM dbo.Tbl' || CAST(l_suppkey % 50 AS STRING) || ' WHERE OrderId = 1'
        WHEN 1 THEN 'INSERT INTO tbl' || CAST(l_suppkey % 50 AS STRING) || ' (OrderId) VALUES (1)'
        WHEN 2 THEN 'UPDATE tbl' || CAST(l_suppkey % 50 AS STRING) || ' SET amount = 1'
        ELSE 'DELETE FROM tbl' || CAST(l_suppkey % 50 AS STRING) END END AS sql_text,
      CASE WHEN l_partkey % 9 = 1 THEN 'queue.' || CAST(l_suppkey % 20 AS STRING) END AS destination,
      CASE WHEN l_partkey % 9 = 4 THEN 'sales.Proc' || CAST(l_partkey % 100 AS STRING) END AS called_process,
      CASE WHEN l_partkey % 9 = 2 THEN '0 ' || CAST(l_linenumber AS STRING) || ' * * *' END AS cron,
      CASE WHEN l_partkey % 9 = 3 THEN 'OrderId,amount,Part' || CAST(l_suppkey % 5 AS STRING) || 'Key' END AS inputs_keys,
      CASE WHEN l_partkey % 9 = 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'http://' ELSE 'https://' END
        || 'svc' || CAST(l_suppkey % 20 AS STRING) || '.internal/api/v' || CAST(l_linenumber AS STRING) END AS url,
      CASE l_linenumber % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method,
      CASE WHEN l_partkey % 9 = 5 THEN 'GET' END AS verb,
      CASE WHEN l_linenumber = 3 THEN 'S1' WHEN l_linenumber = 5 THEN 'S2|S1' END AS run_after,
      CASE WHEN l_linenumber >= 4 THEN 'If.True' END AS branch
    FROM {{lineitem}}""",
)

view(
    "signals",
    """
    SELECT o_orderkey AS signal_id, 'flow.' || lower(c_mktsegment) || '.Order' || CAST(o_orderkey AS STRING) AS name,
      CASE o_orderstatus WHEN 'F' THEN 'workflow' WHEN 'O' THEN 'route' ELSE 'db' END AS kind,
      n_name AS component, lower(c_mktsegment) AS module, r_name AS family,
      'src/' || lower(n_name) || '/orders/o' || CAST(o_orderkey AS STRING) || '.json' AS file,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'POST' WHEN o_orderpriority = '2-HIGH' THEN 'GET' END AS method,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '/orders/{orderId}/' || lower(c_mktsegment) END AS path,
      o_custkey AS custkey, o_orderdate AS created
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
      JOIN {region} ON n_regionkey = r_regionkey""".replace("{orderId}", "' || chr(123) || 'orderId' || chr(125) || '"),
)

view(
    "triggers",
    """
    SELECT signal_id, CASE WHEN method IS NOT NULL THEN 'http' ELSE 'timer' END AS type,
      'start' || CAST(signal_id % 3 AS STRING) AS name, method, path
    FROM $signals WHERE kind <> 'db'""",
)

view(
    "relations",
    """
    SELECT l_orderkey AS signal_id, l_linenumber AS pos, l_partkey AS k1, l_suppkey AS k2,
      CASE l_suppkey % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'invokes' ELSE 'uses' END AS rel_type,
      'S' || CAST(l_linenumber AS STRING) AS source_name,
      CASE WHEN l_linenumber = 1 THEN 'trigger' ELSE 'activity' END AS source_type,
      CASE l_partkey % 5 WHEN 0 THEN 'sql_table' WHEN 1 THEN 'servicebus' WHEN 2 THEN 'http' WHEN 3 THEN 'process' ELSE 'cosmosdb' END AS target_kind,
      'T' || CAST(l_suppkey % 40 AS STRING) AS target_ref,
      CASE l_partkey % 4 WHEN 0 THEN 'reads' WHEN 1 THEN 'writes' WHEN 2 THEN 'deletes' ELSE 'calls' END AS operation
    FROM {lineitem}""",
)

# ---- source files, one per part / customer / supplier / page ------------------------
view(
    "js_files",
    "SELECT 'web/' || lower(p_type) || '/part' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.ts' ELSE '.js' END AS path, "
    + template(
        """import axios from "axios";
import { Pool } from 'pg<<p_size % 2>>';
const express = require('express');

app.get('/parts/:partId/<<p_size>>', handler);
router.put(
  '/stock/:sku/<<p_size % 4>>',
  handler);
db.collection('parts_<<p_size % 7>>').find();
mongoose.model('Brand<<p_partkey % 25>>');
router.post("/brands/:brandKey", (req) => axios.post('https://billing<<p_partkey % 5>>.internal/api'));
fetch("https://stock.internal/v<<p_size % 3>>/items");
axios.get(
  'https://prices<<p_size % 2>>.internal/list');
"""
    )
    + " AS text, p_partkey FROM {part}",
)

view(
    "cs_files",
    "SELECT 'api/' || CAST(s_nationkey AS STRING) || '/Supplier' || CAST(s_suppkey AS STRING) || '.cs' AS path, "
    + template(
        """using System.Net.Http;
using Microsoft.PowerPlatform.Dataverse.Client;
using Internal.Tools<<s_suppkey % 4>>;
[Authorize(Roles = "Admin,Sales_Manager<<s_suppkey % 6>>|Ops")]
public class Supplier<<s_suppkey>>Controller : Controller
[FunctionName("Handle<<s_suppkey>>")]
public static void Run([QueueTrigger("orders-<<s_suppkey % 9>>")] string msg, [CosmosDB("stock", "c<<s_suppkey % 3>>")] out dynamic doc)
"""
    )
    + " AS text FROM {supplier}",
)

view(
    "sql_files",
    "SELECT 'db/migrations/m' || CAST(p_partkey AS STRING) || '.sql' AS path, "
    + template(
        """-- migration <<p_partkey>>
CREATE TABLE dbo.Brand<<p_partkey % 25>> (
  BrandId int NOT NULL,
  label varchar(<<p_size>>)
);

create table dbo.Part<<p_partkey>> (
  PartId int NOT NULL,
  BrandId int,
  size_code varchar(10),
  FOREIGN KEY (BrandId, size_code) REFERENCES dbo.Brand<<p_partkey % 25>> (BrandId, code),
  FOREIGN KEY (PartId) REFERENCES dbo.Stock<<p_partkey % 11>>
);
"""
    )
    + " AS text FROM {part}",
)

view(
    "script_files",
    "SELECT 'pb/w_cust' || CAST(c_custkey AS STRING) || '.srw' AS path, "
    + template(
        """global type w_cust<<c_custkey>> from window
event open
public function integer of_load<<c_custkey % 10>> (long al_id)
  dw_main.retrieve(al_id)
  dw_detail<<c_custkey % 3>>.update()
  lnv_service.of_call<<c_custkey % 7>>(al_id)
  SELECT name FROM customers WHERE customerid = 1;
  insert into audit_<<c_nationkey>> (customerkey) values (1);
  lo_http.sendrequest("GET")
end function
event close
"""
    )
    + " AS text FROM {customer}",
)

view(
    "ui_files",
    "SELECT 'ui/' || lower(c_mktsegment) || '/Cust' || CAST(c_custkey AS STRING) || CASE c_custkey % 3 WHEN 0 THEN '.tsx' WHEN 1 THEN '.component.ts' ELSE '.razor' END AS path, "
    + template(
        """@page "/customers/<<c_nationkey>>"
function CustomerManager<<c_custkey % 4>>Page(props)
const SalesAgentCard = (props) => 1
function helper(x)
<Route path="/orders/<<c_nationkey % 5>>" component={CustomerManager<<c_custkey % 4>>Page} />
<a routerLink="/home/<<c_custkey % 6>>">home</a>
@Component({ selector: 'app-cust-<<c_custkey % 8>>', templateUrl: './cust.html' })
export class CustomerOwnerView<<c_custkey % 3>> extends Base
"""
    )
    + " AS text FROM {customer}",
)

view(
    "xml_files",
    "SELECT 'bw/' || CAST(s_nationkey AS STRING) || '/proc' || CAST(s_suppkey AS STRING) || '.bwp' AS path, "
    + template(
        """<process name="sales.Supplier<<s_suppkey>>">
<activity name="Receive<<s_suppkey % 5>>" type="http.receive"/>
<activity name="Query<<s_suppkey % 7>>" type="jdbc.query" sql="SELECT * FROM stock<<s_suppkey % 6>>"/>
<activity name="Reply" type="http.reply"/>
<transition from="Receive<<s_suppkey % 5>>" to="Query<<s_suppkey % 7>>"/>
<transition from="Query<<s_suppkey % 7>>" to="Reply"/>
<partnerLink name="pl<<s_suppkey % 4>>"/>
<lane name="Sales Desk <<s_suppkey % 3>>"/>
<dataStoreReference name="Ledger &amp;lt;b&amp;gt;<<s_suppkey % 2>>&amp;lt;/b&amp;gt;"/>
<callActivity name="Invoice" calledElement="billing.Invoice<<s_suppkey % 9>>"/>
<portType name="Port<<s_suppkey % 3>>"><operation name="getStock<<s_suppkey % 4>>"/><operation name="putStock"/></portType>
<element name="stockId" type="string"/><element name="qty" type="int"/>
<complexType name="Stock<<s_suppkey % 4>>"/>
<simpleType name="Level"><enumeration value="low"/><enumeration value="high"/></simpleType>
<documentation> Stock level of supplier <<s_suppkey>> </documentation>
</process>"""
    )
    + " AS text FROM {supplier}",
)

view(
    "flow_files",
    "SELECT 'flows/f' || CAST(o_orderkey AS STRING) || '.json' AS path, o_orderkey, "
    + template(
        """{<<CASE WHEN o_orderkey % 3 = 1 THEN chr(34) || 'definition' || chr(34) || ':' || chr(123) ELSE '' END>>"triggers":{"manual":{"type":"Request"},"tick":{"type":"Recurrence","inputs":{"recurrence":{"frequency":"Day","interval":<<o_orderkey % 7>>}}}},
"actions":{"Init":{"type":"Http","inputs":{"method":"GET","uri":"https://svc<<o_custkey % 9>>.internal/api/items?x=1"}},
"Check":{"type":"If","runAfter":{"Init":["Succeeded"]},"actions":{"Save":{"type":"ApiConnection","inputs":{"method":"post","path":"/datasets/default/tables/Orders<<o_custkey % 5>>/items","host":{"connection":{"name":"shared_sql"}}}},
"Loop":{"type":"Foreach","actions":{"Notify":{"type":"Http","inputs":{"method":"POST","uri":"https://hub.internal/workflows/notify<<o_custkey % 4>>/triggers/manual/run"}}}}},
"else":{"actions":{"Stop":{"type":"Terminate"}}}},
"Pick":{"type":"Switch","runAfter":{"Check":["Succeeded"]},"cases":{"a":{"actions":{"CaseA":{"type":"Compose"}}}},"default":{"actions":{"Other":{"type":"Compose"}}}}}<<CASE WHEN o_orderkey % 3 = 1 THEN chr(125) ELSE '' END>>}"""
    )
    + " AS text FROM {orders}",
)

view(
    "spec_files",
    "SELECT 'specs/p' || CAST(p_partkey AS STRING) || '.json' AS path, "
    + template(
        """{"openapi":"3.0.1","info":{"title":"Part API <<p_partkey % 40>>","version":"1.<<p_size % 4>>"},"paths":{
"/api/v<<p_size % 8>>":{"get":{"summary":"list","operationId":"list<<p_partkey>>"},"post":{"summary":"add"},"parameters":[]},
"/parts/<<p_brand>>":{"delete":{"summary":"drop"},"x-note":{"a":1}}}<<CASE WHEN p_partkey % 50 = 7 THEN '' ELSE chr(125) END>>"""
    )
    + " AS text FROM {part}",
)

view(
    "package_files",
    "SELECT 'pkg/s' || CAST(s_suppkey AS STRING) || '/package.json' AS path, "
    + template(
        """{"name":"pkg<<s_suppkey>>","dependencies":{"react":"18.<<s_suppkey % 3>>","express":"4.1"},"devDependencies":{"react":"17.0","jest":"29.<<s_suppkey % 5>>"<<CASE WHEN s_suppkey % 4 <> 0 THEN ',' || chr(34) || 'typescript' || chr(34) || ':' || chr(34) || '5.1' || chr(34) ELSE '' END>>},"scripts":{"build":"tsc -p .","start":"node <<s_suppkey % 4>>"},"compilerOptions":{"strict":true,"target":"es<<2015 + s_suppkey % 6>>"}}"""
    )
    + " AS text FROM {supplier}",
)

view(
    "property_files",
    "SELECT 'conf/c' || CAST(c_custkey AS STRING) || '.properties' AS path, "
    + template(
        """# settings <<c_custkey>>
db.url=jdbc:sql://db<<c_nationkey % 5>>.internal:<<1000 + c_nationkey>>/main
http.host=svc<<c_nationkey>>.internal
http.port=<<8000 + c_nationkey>>
jms.queue = orders.<<c_custkey % 12>>

broken line
endpoint=https://api<<c_custkey % 6>>.internal/v1/orders?x=<<c_nationkey>>
"""
    )
    + " AS text FROM {customer}",
)

view(
    "event_files",
    "SELECT 'fn/e' || CAST(event_id AS STRING) || '.json' AS path, event_id, "
    + template(
        """{"bindings":[{"type":"<<CASE event_id % 3 WHEN 0 THEN 'httpTrigger' WHEN 1 THEN 'queueTrigger' ELSE 'timerTrigger' END>>","direction":"in","name":"req","route":"/<<event_type>>/{userId}","queueName":"q<<user_id % 5>>","schedule":"0 * * * *"},{"type":"<<CASE user_id % 3 WHEN 0 THEN 'cosmosDB' WHEN 1 THEN 'serviceBus' ELSE 'blob' END>>","direction":"out","name":"out","queueName":"out<<user_id % 4>>","collectionName":"c<<user_id % 6>>","path":"box/<<user_id % 3>>"}]}"""
    )
    + " AS text FROM {events}",
)

view(
    "manifest_files",
    "SELECT 'deploy/' || CASE c_custkey % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' WHEN 2 THEN 'qa' ELSE 'develop' END || '/c' || CAST(c_custkey AS STRING) || '.json' AS path, c_custkey, "
    + template(
        """{"kind":"<<CASE c_custkey % 3 WHEN 0 THEN 'Service' WHEN 1 THEN 'Secret' ELSE 'Deployment' END>>","metadata":{"name":"cust<<c_custkey>>"},"spec":{"template":{"spec":{"containers":[
{"name":"web","image":"reg.internal/web:<<c_nationkey>>","env":[{"name":"A","valueFrom":{"secretKeyRef":{"name":"sec<<c_custkey % 4>>"}}},{"name":"B","valueFrom":{"configMapKeyRef":{"name":"cfg<<c_custkey % 5>>"}}},{"name":"C","value":"x"}]},{"name":"side","image":"reg.internal/side:1"}],
"volumes":[{"persistentVolumeClaim":{"claimName":"vol<<c_custkey % 7>>"}},{"secret":{"secretName":"sec9"}}]}}},
"on":{"push":{"branches":["main"]},"schedule":[{"cron":"0 <<c_nationkey>> * * *"}]},"jobs":{"build":{"steps":[{"name":"compile","run":"make all"},{"uses":"actions/upload-artifact","with":{"name":"app<<c_custkey % 4>>"}}]},
"deploy":{"needs":["build"],"environment":"<<CASE WHEN c_custkey % 2 = 0 THEN 'Production' ELSE 'stage' END>>","steps":[{"shell":"bash"}]}}}"""
    )
    + " AS text FROM {customer}",
)

view(
    "mule_files",
    "SELECT 'mule/' || CAST(s_nationkey AS STRING) || '/flow' || CAST(s_suppkey AS STRING) || '.xml' AS path, "
    + template(
        """<mule><flow name="stock<<s_suppkey>>">
<http:listener path="/stock/<<s_suppkey % 5>>" allowedMethods="post,get"/>
<scheduler cron-expression="0 <<s_suppkey % 9>> * * *"/>
<http:request url="https://svc<<s_suppkey % 6>>.internal/items"/>
<db:insert table="stock<<s_suppkey % 3>>"/>
<db:select><db:sql>SELECT * FROM dbo.parts<<s_suppkey % 4>></db:sql></db:select>
<flow-ref name="audit<<s_suppkey % 2>>"/>
</flow></mule>"""
    )
    + " AS text FROM {supplier}",
)

view(
    "serverless_files",
    "SELECT 'fn/s' || CAST(c_custkey AS STRING) || '.json' AS path, c_custkey, "
    + template(
        """{"functions":{"order<<c_custkey % 50>>":{"handler":"h.run","events":[{"http":{"path":"/o/{orderId}","method":"post"}},{"sqs":{"arn":"arn:q:orders<<c_custkey % 6>>"}}]},
"tick":{"handler":"h.tick","events":[{"schedule":{"rate":"rate(<<c_nationkey + 1>> hours)"}},{"stream":{"arn":"arn:d:table<<c_custkey % 4>>"}}]}}}"""
    )
    + " AS text FROM {customer}",
)

# ---- entity graphs --------------------------------------------------------------------
view(
    "geo_nodes",
    """
    SELECT 'Component:' || r_name AS id, 'Component' AS type, r_name AS name, r_name AS component, 'geo/' || r_name AS file FROM {region}
    UNION ALL SELECT 'API:' || n_name, 'API', n_name, r_name, 'geo/' || r_name || '/' || n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT 'Workflow:' || s_name, 'Workflow', s_name, n_name, 'sup/' || n_name || '/' || s_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
    UNION ALL SELECT 'Operation:' || n_name || ' ' || c_mktsegment, 'Operation', min(n_name || ' ' || c_mktsegment), min(n_name), min('ops/' || n_name || '/' || c_mktsegment)
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment
    UNION ALL SELECT 'Datastore:' || p_brand, 'Datastore', p_brand, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {part} GROUP BY p_brand
    UNION ALL SELECT 'Doc:' || source, 'Doc', source, source, 'docs/' || source || '/a' FROM {documents} GROUP BY source""",
)

view(
    "geo_edges",
    """
    SELECT 'Component:' || r_name AS src, 'API:' || n_name AS dst, 'owns' AS type FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT 'API:' || n_name, 'Component:' || r_name, 'member_of' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT 'API:' || n_name, 'Workflow:' || s_name, 'calls' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT 'API:' || n_name, 'Operation:' || n_name || ' ' || c_mktsegment, 'exposes'
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
    UNION ALL SELECT 'Workflow:' || s_name, 'Datastore:' || p_brand, CASE WHEN min(l_linenumber) = 1 THEN 'depends_on' ELSE 'publishes_to' END
      FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY s_name, p_brand""",
)
